"""Change-impact analytics over mapping definitions and lineage graphs, as Spark DataFrames."""
