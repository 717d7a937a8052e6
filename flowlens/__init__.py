"""Network-flow analytics on Spark: metering, scoring, OLAP requests, monitoring, vector search.

Every function takes and returns DataFrames (batch or streaming); nothing here runs a job unless its
docstring says so.
"""
