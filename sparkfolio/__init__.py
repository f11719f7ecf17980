"""Research-corpus analytics on Spark DataFrames."""

from sparkfolio.session import get_spark

__all__ = ["get_spark"]
