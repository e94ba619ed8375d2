"""Column expressions: no function in this package triggers a Spark job."""
