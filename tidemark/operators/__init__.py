"""operators of the panel library."""
