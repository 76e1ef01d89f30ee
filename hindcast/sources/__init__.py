"""Readers, sinks, run layouts and change detection."""
