"""Sheet-network analytics on Spark."""
