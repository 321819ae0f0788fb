"""Operators for preparing training corpora; nothing else in citeflow imports them."""
