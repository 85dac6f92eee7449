"""Training-data operators: corpus operators for very large text tables.

Nothing else in the library imports this subpackage.
"""
