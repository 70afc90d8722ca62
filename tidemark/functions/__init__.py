"""functions of the panel library."""
