"""textloom: document text extraction and large-corpus processing on PySpark."""

__version__ = "0.1.0"
