"""Operators for preparing training text: filters, de-duplication, encodings, packing, search.

Nothing outside this subpackage imports it. Each module holds one operator; queries.py
applies the operators to the driver's tables.
"""
