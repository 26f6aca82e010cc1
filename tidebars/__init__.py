"""Bar and event time series on Spark."""
