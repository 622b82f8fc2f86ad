"""helixframe: interval-annotated sequence and feature-vector analytics on Spark DataFrames."""
