"""Handlers: the metrics of each protocol as plans over normalised event tables."""
