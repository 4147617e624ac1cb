"""Spark-native analytics for coastal imagery tables, catalogues and time series."""
