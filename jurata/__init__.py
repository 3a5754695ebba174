"""jurata: a Spark-native engine for judging, evaluating and publishing batches of records."""
