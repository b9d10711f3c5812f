"""functions of the history engine."""
