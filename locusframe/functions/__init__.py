"""Column functions: genotype counts, exact tests, text helpers."""
