"""gridlens — smart-meter analytics expressed as Spark DataFrame plans.

Layers:
  sources/    readings fixture, typed CSV/Parquet scans, sinks, compaction
  functions/  reusable Column builders (flags, tags, scores, formulas)
  operators/  DataFrame -> DataFrame transforms (clean, holds, features,
              daily rollup, dashboard queries, ML prep, evaluation, scoring)
  plans/      query registry (name -> callable) and DuckDB oracle SQL
  streaming/  Structured Streaming jobs over the same Column builders
"""

__all__ = ["session"]
