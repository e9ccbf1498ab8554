"""Spark-native engine for instruction-following vision-language datasets."""
