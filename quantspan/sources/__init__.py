"""Scans and sinks: price bars, event logs, notes, state tables."""
