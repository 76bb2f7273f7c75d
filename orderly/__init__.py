"""Ordered-data analytics on Spark: frames, intervals, cohorts, lexicons, alignments and logs as DataFrames."""
