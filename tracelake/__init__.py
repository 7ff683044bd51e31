"""tracelake: code-graph reachability analytics on PySpark DataFrames."""
