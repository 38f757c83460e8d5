"""Cash-flow analytics on Spark DataFrames.

Every operator takes DataFrames plus explicit parameters and returns lazy
DataFrames.  Nothing reads the clock: rules, views and logs receive ``as_of``
(a date) or ``run_ts`` (a timestamp) from the caller.
"""
