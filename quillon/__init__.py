"""Panel, statistics, screening and graph operators over Spark DataFrames."""
