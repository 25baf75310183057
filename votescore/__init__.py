"""Account standing from an ordered log of content votes, on PySpark."""

__version__ = "0.1.0"
