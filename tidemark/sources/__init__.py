"""sources of the panel library."""
