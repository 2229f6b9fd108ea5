"""Judging and preparing data on Spark.

``AutoPCP`` scores the prosody likeness of audio pairs; operators, sources and
functions are in the subpackages.
"""

__all__ = ["AutoPCP"]


def __getattr__(name: str):
    if name == "AutoPCP":
        from assayframe.operators.comparator import PairScorer

        return PairScorer
    raise AttributeError(name)
