"""Analytics and forecasting over many price-like daily series, as Spark DataFrame jobs."""
