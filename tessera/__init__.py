"""Entity resolution and relational record processing on Spark DataFrames."""
