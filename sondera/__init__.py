"""sondera: a Spark-native engine for retrieval, evidence and corpus analytics."""
