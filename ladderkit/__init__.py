"""ladderkit - order-book feature engineering, audit and model evaluation as Spark DataFrame operators.

Layout:
  sources/    scans, CSV/JSON sources and sinks, schema alignment (S*)
  functions/  Column-expression builders: safe maths, keys, order-book features (P*, E*)
  operators/  DataFrame operators: profiling, aggregates, quantiles, windows, joins/linking,
              kNN, folds, metrics, blending, audits, Spark ML steps
  plans/      fixture views and the registered query plans (with their DuckDB oracle SQL)
"""

__all__ = ["sources", "functions", "operators", "plans", "session"]
