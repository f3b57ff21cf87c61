"""A Spark-native engine for inspecting and maintaining collections of tabular files."""
