"""Document-readiness analytics and corpus preparation on Spark."""
