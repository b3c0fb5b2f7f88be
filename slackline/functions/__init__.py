"""Column expressions: clocks, geometry, cleaning and delay distributions."""
