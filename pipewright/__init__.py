"""A Spark-native query engine for a small pipe-friendly SQL dialect over versioned tables."""
