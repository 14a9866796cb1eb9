"""PySpark-native analytics over change histories: DataFrames in, DataFrames out."""
