"""corpusloom: a Spark-native analytics engine for document collections."""
