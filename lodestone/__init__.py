"""A Spark-native engine for retrieval, code-graph, text and event analytics."""
