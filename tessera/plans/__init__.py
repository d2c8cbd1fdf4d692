"""Fitted transforms and the catalogue of queries."""
