"""gristmill: preparing, profiling, analysing and retrieving mixed tabular and
text data with PySpark DataFrames."""

__version__ = "0.1.0"
