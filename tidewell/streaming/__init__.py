"""Windowed queries over streams: the whole query is answered anew for each record, or for each tick."""
