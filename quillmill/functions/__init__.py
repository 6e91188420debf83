"""Column functions: text, dates, documents, URLs, linguistics."""
