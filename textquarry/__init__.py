"""textquarry: document analytics, retrieval and corpus preparation on Spark DataFrames."""

from __future__ import annotations

__version__ = "0.1.0"
