"""Reading reviews and writing results."""
