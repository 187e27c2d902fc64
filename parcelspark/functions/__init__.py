"""Column expressions (no UDFs): numbers, text, codes, geometry."""
