"""factloom: program-analysis facts and rule sets as Spark DataFrames."""
