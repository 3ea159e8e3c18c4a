"""Event-stream operators; the same functions serve batch and streaming input."""
