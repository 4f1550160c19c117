"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by workers.

Counting: a task hashes its words to 64 bits, sorts and merges its bigrams, and sends each shard of the
bigram space one packed block of (previous, word, count).  A context's bigrams are spread over eight
shards, so a very common word is no hot spot.  A shard merges its blocks, writes its bigrams as sorted
hash arrays, and passes on sums by context and by word; these are merged the same way into the arrays of
the lower order.  Shards follow the input's bytes, and ``spark.sql.shuffle.partitions`` where that is more,
so a shard does not grow with the input; each is a partition of its own.  All arrays are ``.npy`` files in the shared folder; the workers map them into memory and look
words and bigrams up by sorted search.  Nothing but totals comes to the driver.

Tokens: words between ASCII white space with A-Z lower-cased, then one end, which counts as a token.  The
begin of a text is a context only.  Discounts D1, D2, D3+ come from counts of counts for either order.  The
lower order interpolates with a uniform distribution over the V known tokens and one unknown.

Null and empty texts are the end token alone.  Repeated rows count again.  Without training rows every
token is unknown: train_tokens is 0 and both scores are 0 (log10 of 1, as unknown is all there is).
Rows without a doc_id are not held out.  Only doc_id and text are read,
so other columns may have any name.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import shared
from .chosen_path import WORDS, mixed

BEGIN, END = np.uint64(0x0B5E_B5E0_0000_0001), np.uint64(0x0E4D_E4D0_0000_0002)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
#: Tokens that a task holds before it sorts and sends them.
BUFFER = 1_000_000
#: Tokens that are scored at once.
SCORED = 150_000
#: Bytes of the table for each shard of the model.
SHARD_BYTES = 16 << 20
LOG10 = np.log(10.0)


def tokens(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words and the end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def previous(found: np.ndarray) -> np.ndarray:
    out = np.empty_like(found)
    out[0], out[1:] = BEGIN, found[:-1]
    return out


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * _FOLD + mixed(w))


def pair_shard(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    spread = mixed(v) + mixed(w & np.uint64(7))
    return ((spread >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def word_shard(w: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(w) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of each value column."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[at], *(np.add.reduceat(v[order], at, dtype=v.dtype) if len(at) else v[:0] for v in values)


def _merged_pairs(v: np.ndarray, w: np.ndarray, c: np.ndarray):
    """Distinct (v, w) ordered by v and then w, with summed counts."""
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order]
    if not len(v):
        return v, w, c
    at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    return v[at], w[at], np.add.reduceat(c, at)


def _blocks(shard: np.ndarray, columns: list[np.ndarray], kind: int = 0):
    """One row (kind, shard, payload) per shard; ``shard`` is ascending."""
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    stops = np.append(cuts[1:], len(shard))
    payload = [b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(cuts, stops)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), kind, np.int32)), pa.array(shard[cuts].astype(np.int32)), pa.array(payload, pa.binary())], names=["kind", "shard", "payload"])


BLOCK_SCHEMA = "kind int, shard int, payload binary"


def _unpacked(payloads, kinds: list) -> list[np.ndarray]:
    """Columns of packed blocks, joined."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // width, 0
        for part, k in zip(parts, kinds):
            part.append(np.frombuffer(p, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(part) if part else np.empty(0, k) for part, k in zip(parts, kinds)]


_PAIR = [np.uint64, np.uint64, np.uint32]
_CONTEXT = [np.uint64, np.int64, np.int32, np.int32, np.int32]  # total and numbers of counts 1, 2, 3 or more
_WORD = [np.uint64, np.int64, np.int64]  # count, distinct previous words


def _count(shards: int):
    def flush(held: list[np.ndarray]):
        w = np.concatenate(held)
        # The begin stands before each text's first token: after an end, and at the buffer's own begin.
        v = np.empty_like(w)
        v[0], v[1:] = BEGIN, w[:-1]
        v[1:][w[:-1] == END] = BEGIN
        v, w, c = _merged_pairs(v, w, np.ones(len(w), np.uint32))
        s = pair_shard(v, w, shards)
        order = np.argsort(s, kind="stable")
        return _blocks(s[order], [v[order], w[order], c[order].astype(np.uint32)])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for text in shared.utf8_rows(batch.column(0)):
                held.append(tokens(bytes(text)))
                n += len(held[-1])
                if n >= BUFFER:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _by_shard(batches, width: int = 2):
    """Payloads of each (kind, shard) in turn, from batches that are sorted by them."""
    at, held = None, []
    for batch in batches:
        for kind, shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.utf8_rows(batch.column(2))):
            if (kind, shard) != at and held:
                yield at, held
                held = []
            at = (kind, shard)
            held.append(bytes(payload))
    if held:
        yield at, held


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _merge_pairs(folder: str, shards: int):
    """A shard's bigrams: written as sorted hash arrays, then summed by context and by word."""

    def run(batches):
        for (_, shard), payloads in _by_shard(batches):
            v, w, c = _merged_pairs(*_unpacked(payloads, _PAIR))
            c = c.astype(np.int64)
            key = pair_key(v, w)
            order = np.argsort(key)
            shared.write_array(f"{folder}/pair-key-{shard}.npy", key[order])
            shared.write_array(f"{folder}/pair-count-{shard}.npy", np.minimum(c, 2**32 - 1).astype(np.uint32)[order])
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([shard], pa.int32()), pa.array([np.array(_counts_of_counts(c), np.int64).tobytes()], pa.binary())], names=["kind", "shard", "payload"])
            one, two, more = c == 1, c == 2, c >= 3
            x = _summed(v, c, one.astype(np.int32), two.astype(np.int32), more.astype(np.int32))
            for kind, out in ((0, x), (1, _summed(w, c, np.ones(len(w), np.int64)))):
                s = word_shard(out[0], shards)
                order = np.argsort(s, kind="stable")
                yield _blocks(s[order], [a[order] for a in out], kind)

    return run


def _merge_words(folder: str):
    """A shard of the lower order, from both kinds of sums; its totals."""

    def write(shard: int, context: list[bytes], word: list[bytes]):
        v, total, n1, n2, n3 = _summed(*_unpacked(context, _CONTEXT))
        w, count, before = _summed(*_unpacked(word, _WORD))
        key = np.union1d(v, w)
        i, j = np.searchsorted(key, v), np.searchsorted(key, w)
        out = np.zeros(len(key), [("count", "i8"), ("before", "i8"), ("total", "i8"), ("n1", "i4"), ("n2", "i4"), ("n3", "i4")])
        for name, at, x in (("total", i, total), ("n1", i, n1), ("n2", i, n2), ("n3", i, n3), ("count", j, count), ("before", j, before)):
            out[name][at] = x
        shared.write_array(f"{folder}/word-key-{shard}.npy", key)
        shared.write_array(f"{folder}/word-{shard}.npy", out)
        sums = [int(count.sum()), len(w), int(before.sum()), *_counts_of_counts(before)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, *sums)], names=["shard", "tokens", "words", "pairs", "c1", "c2", "c3", "c4"])

    def run(batches):
        now, parts = None, {0: [], 1: []}
        # Sorted by shard: the two kinds of one shard stand side by side.
        for batch in batches:
            for kind, shard, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.utf8_rows(batch.column(2))):
                if shard != now and now is not None:
                    yield write(now, parts[0], parts[1])
                    parts = {0: [], 1: []}
                now = shard
                parts[kind].append(bytes(payload))
        if now is not None:
            yield write(now, parts[0], parts[1])

    return run


def discounts(c: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from the numbers of counts 1 to 4, within the bounds that keep them discounts."""
    n1, n2, n3, n4 = (max(0, x) for x in c)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))


class Model:
    """What a worker needs to score: where the arrays are, and the totals."""

    def __init__(self, folder: str, shards: int, tokens: int, words: int, pairs: int, low: tuple, high: tuple):
        self.folder, self.shards, self.tokens, self.words, self.pairs = folder, shards, tokens, words, pairs
        self.low, self.high = low, high
        self.arrays: dict[str, np.ndarray | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"arrays": {}}

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.arrays:
            try:
                self.arrays[name] = shared.map_array(f"{self.folder}/{name}.npy")
            except FileNotFoundError:  # a shard to which nothing fell
                self.arrays[name] = None
        return self.arrays[name]

    def _found(self, keys: np.ndarray, shard: np.ndarray, key_name: str, value_name: str, empty):
        """Values at the keys, zero where there are none; sorted search shard by shard."""
        order = np.lexsort((keys, shard))
        k, s = keys[order], shard[order]
        out = np.zeros(len(keys), empty)
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(s)).tolist()):
            table, values = self.array(f"{key_name}-{s[a]}"), self.array(f"{value_name}-{s[a]}")
            if table is None or not len(table):
                continue
            at = np.minimum(np.searchsorted(table, k[a:b]), len(table) - 1)
            hit = table[at] == k[a:b]
            out[order[a:b][hit]] = values[at[hit]]
        return out

    def word_rows(self, w: np.ndarray) -> np.ndarray:
        kind = [("count", "i8"), ("before", "i8"), ("total", "i8"), ("n1", "i4"), ("n2", "i4"), ("n3", "i4")]
        return self._found(w, word_shard(w, self.shards), "word-key", "word", kind)

    def lower(self, before: np.ndarray) -> np.ndarray:
        """P(word) of the lower order from the numbers of distinct previous words."""
        d1, d2, d3, spare = self.low
        less = np.where(before == 1, d1, np.where(before == 2, d2, d3))
        return np.where(before > 0, (before - less) / max(1, self.pairs), 0.0) + spare / (self.words + 1)

    def log10(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(w | v), and the training count of w, for each token."""
        if not self.tokens:
            return np.zeros(len(w)), np.zeros(len(w), np.int64)
        words, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        rows = self.word_rows(words)
        low = self.lower(rows["before"])
        i, j = at[: len(v)], at[len(v) :]
        d = self.high
        total = rows["total"]
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, (d[0] * rows["n1"] + d[1] * rows["n2"] + d[2] * rows["n3"]) / total, 1.0)
        c = self._found(pair_key(v, w), pair_shard(v, w, self.shards), "pair-key", "pair-count", np.uint32).astype(np.int64)
        less = np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))
        top = np.where(c > 0, (c - less) / np.maximum(1, total[i]), 0.0)
        return np.log(top + back[i] * low[j]) / LOG10, rows["count"][j]


def shards_of(spark: SparkSession, docs: DataFrame) -> int:
    """Shards of the model: one for each ``SHARD_BYTES`` of the table, or as many as Spark's shuffle partitions."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # plans without statistics say more than any table holds
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(known / SHARD_BYTES))


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Count ``docs`` (column text) into a model below the shared folder."""
    folder = shared.work_dir(spark, "ngram_lm")
    shards = shards_of(spark, docs)
    counted = docs.select(F.col("text").cast("string").alias("text")).transform(shared.in_arrow, _count(shards), BLOCK_SCHEMA)
    dealt = counted.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "shard")
    merged = shared.saved(dealt.transform(shared.in_arrow, _merge_pairs(folder, shards), BLOCK_SCHEMA), f"{folder}/sums")
    high = np.zeros(4, np.int64)
    for r in merged.where("kind = 2").select("payload").toLocalIterator():  # four numbers a shard
        high += np.frombuffer(r[0], np.int64)
    words = merged.where("kind < 2").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    schema = "shard long, tokens long, words long, pairs long, c1 long, c2 long, c3 long, c4 long"
    sums = words.transform(shared.in_arrow, _merge_words(folder), schema).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "pairs", "c1", "c2", "c3", "c4"))).first()
    shared.delete(spark, f"{folder}/sums")
    total, known, pairs, *low = (int(x) for x in sums)
    d = discounts(low)
    more = known - low[0] - low[1]
    spare = (d[0] * low[0] + d[1] * low[1] + d[2] * more) / pairs if pairs else 1.0
    return Model(folder, shards, total, known, pairs, (*d, spare), discounts(high.tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity for every row."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # a path and a few numbers

    def flush(model: Model, ids: list, held: list[np.ndarray]):
        n = np.array([len(x) for x in held])
        w = np.concatenate(held)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[starts] = BEGIN
        logs, count = model.log10(v, w)
        base = np.log((count + 1) / (model.tokens + model.words + 1)) / LOG10
        s = np.add.reduceat(logs, starts)
        columns = [pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300.0))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    def run(batches):
        model, ids, held, size = shared_model.value, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), shared.utf8_rows(batch.column(1))):
                ids.append(i)
                held.append(tokens(bytes(text)))
                size += len(held[-1])
                if size >= SCORED:
                    yield flush(model, ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield flush(model, ids, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shared.in_arrow, run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(spark, docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
