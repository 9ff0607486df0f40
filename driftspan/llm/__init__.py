"""Training-data operators on Spark DataFrames. Nothing else in driftspan imports this subpackage."""
