"""Dictionary-driven morphological analytics as Spark query plans."""

__version__ = "0.1.0"
