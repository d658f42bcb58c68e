"""A PySpark-native analytics engine: declarative plans over DataFrames, SQL and Structured Streaming."""
