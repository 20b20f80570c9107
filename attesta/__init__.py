"""attesta: Spark operators for model governance, text redaction and feature evaluation."""

__version__ = "0.1.0"
