"""Table operators for metered time series on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function over
configurable entity, time and value columns.
"""
