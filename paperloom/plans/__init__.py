"""Plans: the flagship query, the upload lifecycle and the registered queries."""
