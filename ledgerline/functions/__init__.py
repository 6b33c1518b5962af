"""Column-level functions (built-in Spark expressions; one Arrow UDF for Jaro-Winkler)."""
