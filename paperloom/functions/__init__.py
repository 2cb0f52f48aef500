"""Column functions: text, policy, invariants and masking."""
