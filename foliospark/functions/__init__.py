"""Column expressions, and the few pandas UDFs that they need."""
