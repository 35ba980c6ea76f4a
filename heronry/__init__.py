"""heronry: knowledge search, change-impact and corpus analytics on PySpark."""

__version__ = "0.1.0"
