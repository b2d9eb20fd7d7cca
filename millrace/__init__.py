"""Millrace: a PySpark-native analytics engine on the public DataFrame, SQL and Structured Streaming APIs."""
