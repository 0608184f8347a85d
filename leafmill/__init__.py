"""A Spark-native engine for structured documents and the retrieval pipelines built on them."""
