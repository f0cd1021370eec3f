"""patronage: customer analytics as Spark jobs.

Customer and transaction tables go in; cleaned and joined tables, recency /
frequency / monetary features, churn scores, risk levels, value segments,
stored runs and dashboard reports come out. Everything is DataFrame, SQL,
``pyspark.ml`` or Structured Streaming code.
"""
