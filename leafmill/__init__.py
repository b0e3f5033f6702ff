"""leafmill: page analytics and page processing expressed as Spark plans."""

__version__ = "0.1.0"
