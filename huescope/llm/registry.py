"""What ``__spark_entry__`` registers of this subpackage."""

from __future__ import annotations

from huescope.llm.oracles import ORACLES
from huescope.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
