"""operators of the history engine."""
