"""Safe test data on Spark: subset, mask, generate, discover, check and replay tables as DataFrame jobs."""
