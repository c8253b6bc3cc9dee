"""Reference geography and bulk spatial data work as Spark DataFrames."""
