"""PySpark analytics over large collections of small lattices (one DAG per sentence)."""

__version__ = "0.1.0"
