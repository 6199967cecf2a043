"""siltworks: asset optimisation dataflows expressed as Spark DataFrames."""
