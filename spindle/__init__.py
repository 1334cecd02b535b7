"""A property-graph and document engine on Spark DataFrames."""
