"""veldt: sparse matrices and block vectors as Spark DataFrames."""
