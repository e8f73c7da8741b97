"""Evidence retrieval and checking over DataFrames.

Documents, passages, vectors, queries, answers and citations are tables; every
operator takes DataFrames and returns DataFrames, and answers a whole table of
queries in one job.
"""

from lexquarry.config import EngineConfig

__all__ = ["EngineConfig"]
