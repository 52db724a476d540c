"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; it may use the rest of the library.
"""
