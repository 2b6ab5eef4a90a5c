"""tillroll: retail basket analytics as Spark DataFrame jobs.

Sub-packages:
  sources    readers and writers for basket files, catalogues and processed tables
  functions  scalar Column helpers (calendar, labels, safe arithmetic)
  operators  the analytic operators (facts, KPIs, time series, statistics,
             quality checks, catalogue upserts, recommendations, rules, segments)
  plans      compositions of operators (rebuild pipeline, processed warehouse)
  streaming  incremental basket ingestion with Structured Streaming
"""

__version__ = "0.1.0"
