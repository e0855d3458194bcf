"""Column expressions: hashing, seeded draws, record and message expressions."""
