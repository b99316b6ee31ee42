"""Column expressions: names, contacts, truth values, JSON in text, text templates."""
