"""A relational and data-processing engine expressed in PySpark DataFrames."""
