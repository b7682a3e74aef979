"""A Spark-native engine for graph retrieval over text, with training-data operators beside it."""
