"""Column expressions. Everything here stays inside the JVM; no Python runs per row."""
