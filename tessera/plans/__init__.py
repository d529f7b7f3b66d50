"""The SQL dialect: text to syntax tree, syntax tree to DataFrames."""
