"""Parsers that turn the bytes of one document into Markdown."""
