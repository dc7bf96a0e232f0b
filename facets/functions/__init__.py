"""Column expressions: text, calendar, numeric and category columns."""
