"""Column expressions: text, markers, parsing, keywords, dates and scores."""
