"""Column expressions: every function takes and returns a Column and stays inside the JVM."""
