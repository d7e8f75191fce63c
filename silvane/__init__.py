"""silvane: a PySpark-native engine for collections of files, archives and text corpora."""

__version__ = "0.1.0"
