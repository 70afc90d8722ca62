"""streaming of the panel library."""
