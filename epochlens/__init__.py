"""Historical-interval time-series analytics on Spark."""
