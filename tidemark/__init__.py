"""Payment-ledger analytics on Spark DataFrames."""
