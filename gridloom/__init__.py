"""gridloom: tile analytics on Spark DataFrames."""
