"""Readers and writers of annotated text formats."""
