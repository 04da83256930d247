"""Spark-native quality analysis of recorded robot demonstrations."""
