"""kinweave: record linkage for historical person mentions, expressed as Spark DataFrames."""
