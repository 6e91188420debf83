"""Algorithms, configuration, the engine and the query catalogue."""
