"""Spark operators for moving tables between systems and proving the move was right."""
