"""Factor panels, cross-sectional aggregates and time-series transforms on Spark DataFrames."""
