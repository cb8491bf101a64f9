"""Readers, stores, formats and sinks of declared tables."""
