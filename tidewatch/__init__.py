"""Entity time-series anomaly scoring, alerting and evaluation on Spark DataFrames."""
