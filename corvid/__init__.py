"""corvid: hybrid retrieval, its evaluation, and corpus processing on Spark."""
