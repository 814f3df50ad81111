"""loomstat: dataset profiling, schema inference and synthetic data on PySpark DataFrames."""
