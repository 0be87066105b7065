"""assayloom: Spark-native analytics for laboratory measurement data."""
