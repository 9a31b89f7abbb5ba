"""Operators for large training-data tables. Nothing else in the library imports this subpackage."""
