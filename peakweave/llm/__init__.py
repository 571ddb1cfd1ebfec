"""Operators for preparing training text: duplicates, quality, tokens, secrets, packing, web pages."""
