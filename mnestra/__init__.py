"""mnestra: agent-memory analytics on PySpark.

Records, vectors, an inverted index and a triple store are plain DataFrames; every
operator is a function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"
