"""streamloom: stream and batch analytics over partitioned event logs, on Spark DataFrames."""
