"""Event-time windows, stream joins and keyed sinks."""
