"""Special functions as column expressions."""
