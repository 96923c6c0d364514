"""Column expressions: patterns, validators and text helpers."""
