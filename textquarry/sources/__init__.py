"""Readers, document parsing and sinks."""
