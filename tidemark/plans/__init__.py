"""plans of the panel library."""
