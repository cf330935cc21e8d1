"""Reading, conforming and writing enforcement records."""
