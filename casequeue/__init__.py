"""Complaint-case operations analytics on Spark DataFrames."""
