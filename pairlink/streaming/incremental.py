"""Linking a stream of new records against a table at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairlink.operators.compare import Compare
from pairlink.operators.indexing import Block
from pairlink.plans.linkage import block_and_compare
from pairlink.records import RecordSet


def stream_link(stream: DataFrame, stream_id: str, table: RecordSet, block: Block, compare: Compare, sum_above: float | None = None) -> DataFrame:
    """Similarity vectors of each arriving record with the records of ``table`` in its block (a stream-static join).

    The stream is stateless, so no watermark is needed; features over all pairs (frequencies) don't apply.
    ``sum_above`` as in :func:`~pairlink.plans.linkage.block_and_compare`.
    """
    if not stream.isStreaming:
        raise ValueError("the left side is no stream")
    return block_and_compare(block, compare, RecordSet(stream, stream_id), table, sum_above)
