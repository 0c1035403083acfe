"""A Spark-native engine that indexes and searches collections of source files, documents and chat transcripts."""
