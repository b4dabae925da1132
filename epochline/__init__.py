"""Long-horizon, irregularly sampled time series on Spark.

Every operator takes a DataFrame and returns a DataFrame. The time axis is a plain number (a signed
year, a day count, an epoch second), never a timestamp, so it may reach far below zero.
"""
