"""Column expressions: each takes and returns Columns and stays in the JVM."""
