"""lodeplane: graph layout and 2-D point analytics expressed as Spark DataFrames."""
