"""A Spark-native web discovery engine: DataFrames in, DataFrames out."""
