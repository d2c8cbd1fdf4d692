"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage; it needs nothing of the
rest either, so that both can be used alone.
"""
