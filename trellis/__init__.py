"""Property-graph analytics over tables, compiled to Spark DataFrames."""
