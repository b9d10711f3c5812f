"""streaming of the history engine."""
