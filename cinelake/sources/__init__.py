"""Readers of media files and code-table texts, and writers of the resulting tables."""
