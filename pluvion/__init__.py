"""Spark-native analytics for station time series and gridded-product estimates."""
