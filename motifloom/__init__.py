"""Spark-native analytics for short sequences: search, clustering, motifs, evaluation."""
