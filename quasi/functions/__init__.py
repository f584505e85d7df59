"""Column expressions (JVM side) and small driver-side distribution functions."""
