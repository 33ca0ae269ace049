"""Operators for preparing large training corpora (dedup, WARC, extraction, tokens, filters)."""
