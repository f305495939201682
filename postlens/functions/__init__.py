"""Column expressions: everything here is row-local and stays in the JVM."""
