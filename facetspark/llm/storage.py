"""Intermediates as Parquet in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from facetspark.session import store as stored

__all__ = ["stored"]
