"""lawloom: Spark-native document parsing, chunking and hybrid retrieval."""
