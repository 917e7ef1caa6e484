"""Spark-native analytics over provenance graphs and text corpora."""
