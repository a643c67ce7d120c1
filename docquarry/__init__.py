"""docquarry: document analytics and hybrid retrieval on plain Spark DataFrames."""
