"""Readers: file trees, page and paragraph rows, table schemas, template rows."""
