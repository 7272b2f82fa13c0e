"""quarrycast: set-based analytics over job boards, funding feeds and mail on PySpark."""

__version__ = "0.1.0"
