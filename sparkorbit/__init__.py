"""sparkorbit: leakage-controlled classification analytics on PySpark DataFrames."""
