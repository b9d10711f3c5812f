"""sources of the history engine."""
