"""Operators for the preparation of language-model training data, one module per operator.

Nothing outside this package imports it. ``queries.py`` applies every operator
to the driver's tables.
"""
