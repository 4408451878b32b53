"""pagewright: document-layout analytics on PySpark DataFrames."""
