"""Column expressions: time, colour and coordinate."""
