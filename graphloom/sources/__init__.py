"""Scans, extraction from source text, stores and settings files."""
