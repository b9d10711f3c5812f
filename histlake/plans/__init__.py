"""plans of the history engine."""
