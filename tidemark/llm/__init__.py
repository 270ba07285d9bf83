"""Operators that prepare training data: deduplication, scanning, cleaning, mixing and tokenising of text."""
