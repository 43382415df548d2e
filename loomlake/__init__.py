"""loomlake: an analytics and data-preparation library written for Spark DataFrames."""
