"""Column -> Column functions. Everything stays inside whole-stage codegen; there is no Python UDF here."""
