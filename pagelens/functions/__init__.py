"""Column expressions. All run in the JVM; none uses a Python UDF."""
