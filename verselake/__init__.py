"""verselake: transcript, lyric and speech-corpus analytics as PySpark DataFrame operations."""

__version__ = "0.1.0"
