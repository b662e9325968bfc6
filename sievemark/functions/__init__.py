"""Column expressions (JVM side only)."""
