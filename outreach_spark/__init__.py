"""Contact-funnel and engagement analytics as lazy Spark DataFrame operators.

Layout:
  sources/    adapters from the landed tables and the scans / catalogue readers
  functions/  Column-expression helpers (email rules, text rules)
  operators/  DataFrame -> DataFrame operators (dedupe, verify, metrics, ranking, funnel, ...)
  streaming/  Structured Streaming versions of the event operators
  plans/      the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
