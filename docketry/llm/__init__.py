"""Operators that prepare text corpora for language-model training.

Each module holds one operator with its own interface; ``queries`` holds the
registered ``opN_`` queries and their SQL.  Nothing outside imports this.
"""
