"""Applying fitted tables to streams."""
