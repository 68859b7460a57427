"""terravet: data-quality, evidence and spatial-audit operators on Spark.

Operators take DataFrames (or Columns) and return DataFrames (or Columns).
"""
