"""annalist: a Spark-native engine over append-only state ledgers."""
