"""sievemark: curation, scoring and quality control of labelled records on Spark.

Every operator takes DataFrames and returns a DataFrame.  Nothing here
iterates over records on the driver; what does reach the driver is bounded by
a parameter (bucket boundaries, a handful of fitted coefficients, one page).
"""
