"""weftgraph: code-graph analytics and corpus preparation on Spark DataFrames."""
