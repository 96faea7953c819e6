"""Spark-native multimodal video retrieval and temporal alignment."""
