"""Token features for training: label masks, padding and greedy packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def label_mask(ids: Column, prompt_length: Column, most: int) -> Column:
    """Prompt positions are ignored; if the prompt fills the row, all are."""
    kept = F.slice(ids, 1, most)
    n, p = F.size(kept), F.least(prompt_length, F.size(kept))
    body = F.slice(kept, p + 1, F.greatest(n - p, F.lit(0)))
    return F.concat(F.array_repeat(F.lit(IGNORED), p), body)


def pad(ids: Column, length: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def pack(rows: DataFrame, shard: str, order: str, ids: str, most: int, eos: int, whole: bool = False) -> DataFrame:
    """Sequences joined by a masked end token up to ``most`` tokens: (shard, pack, members, input_ids, labels).

    Greedy and in order inside a shard; rows stream through, and only the open pack is held.  A sequence of more
    tokens ends there, as the trainer's rows do; ``whole`` puts its further pieces in one after the other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, k, members, tokens, labels = None, 0, [], [], []

        def row():
            return (at, k, list(members), list(tokens), list(labels))

        for pdf in batches:
            out = []
            pieces = ((s, o, x[k : k + most]) for s, o, x in zip(pdf["shard"], pdf["ord"], map(list, pdf["ids"])) for k in range(0, max(1, len(x)) if whole else 1, most))
            for s, o, x in pieces:
                if s != at or len(tokens) + len(x) + bool(tokens) > most:
                    if members:
                        out.append(row())
                    k = 0 if s != at else k + 1
                    at, members, tokens, labels = s, [], [], []
                if tokens:
                    tokens.append(eos)
                    labels.append(IGNORED)
                members.append(o)
                tokens += x
                labels += x
            yield pd.DataFrame(out, columns=["shard", "pack", "members", "input_ids", "labels"])
        if members:
            yield pd.DataFrame([row()], columns=["shard", "pack", "members", "input_ids", "labels"])

    part = rows.select(F.col(shard).cast("long").alias("shard"), F.col(order).cast("long").alias("ord"), F.col(ids).cast("array<int>").alias("ids"))
    return part.repartition("shard").sortWithinPartitions("shard", "ord").mapInPandas(run, "shard long, pack long, members array<long>, input_ids array<int>, labels array<int>")
