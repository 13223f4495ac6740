"""Spark-native analytics for large transfer graphs."""

from .session import build_session

__all__ = ["build_session"]
