"""Operators for preparing training data at scale, one module each.

Nothing else in the library imports this subpackage. ``queries.py`` registers
one thin query for each operator; the modules hold the operators themselves.
"""
