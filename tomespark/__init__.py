"""A PySpark-native engine for collections of legacy help files and for training-data tables."""

__version__ = "0.1.0"
