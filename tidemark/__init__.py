"""Tidemark: curating labelled image collections and evaluating embeddings, on Spark.

Every public operator takes DataFrames and returns a DataFrame (or a small
result object holding DataFrames).  Nothing here owns an execution engine:
plans are declared with the DataFrame API and Catalyst, adaptive execution and
Arrow batches do the work.
"""

__version__ = "0.1.0"
