"""Filling containers of fixed capacity: variable-capacity best fit.

Texts larger than the capacity are split into full containers and a rest; nothing else is split.  Items are
spread over shards of a bounded number of items by a hash, and each shard is packed on its own in falling
order of size: an item goes into the fullest open container that still holds it; when none does, the
permitted length with the least cost per token it can be expected to carry is opened, judged by the sizes
that are still to come; at the end each container shrinks to the smallest permitted length that holds its
contents.  A shard leaves a few part-filled containers at most, so the loss falls with the shard size.

Edge cases: null and empty texts have no token and get no container; ties are packed in the order of key and
size, so the result is deterministic; repeated keys are separate items, and a key that fills more
than a shard by itself is dealt out over all of them; other columns are pruned.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlink.llm.tokens import DEFAULT_TOKENIZER, with_token_counts
from pairlink.scratch import Scratch


def permitted_lengths(capacity: int, steps: int = 4) -> list[int]:
    """The capacity and its halves, smallest first."""
    return sorted({max(1, capacity >> i) for i in range(steps)})


def best_fit(sizes: Sequence[int], lengths: Sequence[int], overhead: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, final length of each container) for items no larger than the last length.

    ``overhead`` is what a container costs besides its length.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    rising = np.sort(sizes)
    volume = np.append(0, np.cumsum(rising))
    order = np.argsort(-sizes, kind="stable")
    bin_of = np.empty(len(sizes), dtype=np.int64)
    length: list[int] = []
    free: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for done, item in enumerate(order):
        size = int(sizes[item])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room], rooms[at]
        else:
            left = len(sizes) - done - 1
            best = None
            for full in lengths:
                if full < size:
                    continue
                fitting = min(int(np.searchsorted(rising, full - size, side="right")), left)
                carried = size + min(full - size, int(volume[fitting]))
                cost = ((full + overhead) / carried, -full)
                if best is None or cost < best[0]:
                    best = (cost, full)
            b, room = len(length), best[1]
            length.append(room)
            free.append(room)
        bin_of[item] = b
        room -= size
        free[b] = room
        if room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append(b)
    used = np.asarray(length, dtype=np.int64) - np.asarray(free, dtype=np.int64)
    return bin_of, np.asarray(lengths, dtype=np.int64)[np.searchsorted(lengths, used)] if len(used) else used


def pack(
    docs: DataFrame, key: str, text: str, capacity: int, lengths: Sequence[int] | None = None, tokenizer: str = DEFAULT_TOKENIZER, shard_items: int = 20_000, overhead: int = 16
) -> DataFrame:
    """One row per piece: (key, piece_no, n_pieces, first_token, n_tokens, shard, container, container_tokens, container_used)."""
    sizes = with_token_counts(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "n", tokenizer)
    return pack_sizes(sizes, "k", "n", capacity, lengths, shard_items, overhead).withColumnRenamed("k", key)


def pack_sizes(sizes: DataFrame, key: str, size: str, capacity: int, lengths: Sequence[int] | None = None, shard_items: int = 20_000, overhead: int = 16) -> DataFrame:
    """As :func:`pack`, for items whose size is already known."""
    lengths = sorted(lengths or permitted_lengths(capacity))
    if lengths[-1] != capacity or lengths[0] < 1:
        raise ValueError("the largest permitted length must be the capacity")
    spark = sizes.sparkSession
    items = Scratch(spark, "packing").save(sizes.select(F.col(key).alias("k"), F.col(size).cast("long").alias("n")).filter("n > 0"))
    shards = max(1, -(-items.count() // shard_items))
    schema = T.StructType(
        [items.schema["k"], T.StructField("piece_no", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("first_token", T.LongType()), T.StructField("n_tokens", T.LongType()),
         T.StructField("shard", T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("container_tokens", T.LongType()), T.StructField("container_used", T.LongType())]
    )

    def fill(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "n"], kind="stable")
        keys, n = pdf["k"].to_numpy(), pdf["n"].to_numpy()
        whole, rest = n // capacity, n % capacity
        small = np.flatnonzero(rest)
        bin_of, final = best_fit(rest[small], lengths, overhead)
        used = np.bincount(bin_of, rest[small], len(final)).astype(np.int64)
        row = np.repeat(np.arange(len(n)), whole)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        full = pd.DataFrame({"at": row, "piece_no": nth, "n_tokens": capacity, "container": len(final) + np.arange(len(row)), "container_tokens": capacity, "container_used": capacity})
        part = pd.DataFrame({"at": small, "piece_no": whole[small], "n_tokens": rest[small], "container": bin_of, "container_tokens": final[bin_of], "container_used": used[bin_of]})
        out = pd.concat([full, part], ignore_index=True)
        at = out.pop("at").to_numpy()
        out["k"], out["n_pieces"], out["shard"] = keys[at], whole[at] + (rest[at] > 0), shard[0]
        out["first_token"] = out["piece_no"] * capacity
        return out[[f.name for f in schema.fields]]

    # a key of more rows than a shard should hold is dealt out over all shards, by how often each size occurs
    heavy = items.groupBy(F.col("k").alias("hk")).agg(F.count("*").alias("c")).filter(F.col("c") > shard_items)
    same = F.col("k").eqNullSafe(F.col("hk"))
    light = items.join(heavy, same, "left_anti").select("k", "n", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("s"))
    dealt = items.join(heavy, same, "left_semi").groupBy("k", "n").agg(F.count("*").alias("c"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.least(F.col("c"), F.lit(shards)) - 1)))
    times = F.expr(f"c div {shards}") + F.when(F.col("o") < F.col("c") % shards, 1).otherwise(0)
    dealt = dealt.select("k", "n", F.pmod(F.xxhash64("k", "n") + F.col("o"), F.lit(shards)).cast("int").alias("s"), F.explode(F.sequence(F.lit(1), times))).drop("col")
    sharded = light.union(dealt)
    return sharded.groupBy("s").applyInPandas(fill, schema).withColumnRenamed("k", key)


def containers(packed: DataFrame) -> DataFrame:
    """One row per container: (shard, container, capacity, used, n_items)."""
    return packed.groupBy("shard", "container").agg(F.first("container_tokens").alias("capacity"), F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
