"""Operators of a training-data pipeline: tokens, text extraction, duplicates, privacy and quality."""
