"""Business-analytics operators for PySpark.

Every operator is a function from DataFrames to a DataFrame: columns, thresholds and the
reference date are arguments, nothing is executed until the caller runs an action.
"""
