"""Compositions of operators that answer one question as a whole."""
