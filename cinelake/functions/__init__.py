"""Column expressions: bit fields, picture headers, predictors. No UDFs."""
