"""Readers of records and of labelled tables."""
