"""Recursive-descent parsers that tell whether a text is of its language, and where not."""
