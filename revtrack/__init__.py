"""Revision tracker: posts -> documents -> dated versions -> reports, as Spark DataFrame jobs."""

from .session import configure, stage

__all__ = ["configure", "stage"]
