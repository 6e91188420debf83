"""Scans, imports, dictionaries and sinks."""
