"""User-level jobs composed from operators. Each returns lazy DataFrames unless it writes."""
