"""The index algorithms."""

from pairlink.operators.indexing import Block, Full, NeighbourhoodBlock, Random, SortedNeighbourhood  # noqa: F401
