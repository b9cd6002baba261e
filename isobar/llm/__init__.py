"""Operators for building training corpora from text, web pages and vectors."""
