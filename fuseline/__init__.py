"""Spark-native multi-source data fusion, quality profiling and corpus preparation."""
