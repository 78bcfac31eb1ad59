"""lodestrata: a Spark-native toolkit for prompt-compression corpora and training-data pipelines.

Operators take and return DataFrames (or Columns); nothing here starts a job
unless its docstring says so.
"""

__version__ = "0.1.0"
