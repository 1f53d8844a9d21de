"""graphloom: graph and knowledge-graph analytics expressed as Spark DataFrames."""
