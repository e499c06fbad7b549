"""Column expressions: value rules, canonical text, fingerprints, log positions."""
