"""Readers, landed API records and sinks."""
