"""tapeframe: ordered market-data operators on Spark DataFrames."""
