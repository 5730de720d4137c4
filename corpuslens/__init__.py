"""corpuslens: a PySpark-native analytics engine for multilingual text corpora."""

__version__ = "0.1.0"
