"""A Spark-native k-mer analytics engine."""
