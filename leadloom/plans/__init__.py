"""The query registry."""
