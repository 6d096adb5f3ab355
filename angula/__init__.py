"""Site-level distribution analytics on Spark."""
