"""Suffix-array dedup: sparse suffix arrays over minimiser positions, neighbours compared, matches extended.

A position is kept if its ``gram``-word hash is the least in some window of ``window`` positions, so equal
passages keep equal positions; a passage of window + gram + prefix - 2 words or more has one with ``prefix``
words from there on.  Positions whose prefix is found in several documents are sorted over all partitions
twice: by what follows the prefix and by what stands before it, word by word for ``tail`` words and then by
hashes of runs that grow by half.  In each order the neighbours of another document before and after a position
share most with it.  All positions that share as much with it as the better of the two stand around it; it is
compared with two of them, in documents that hold most shared positions for their length.  So a passage found n
times makes at most 4n pairs, these are of few different documents, as a group of copies meets at the same ones,
and a hot passage is cut at range bounds (the rows at the bounds are compared in a second pass).  Matches are then
extended to the left and right over the words of both documents.  A position where all documents agree on the
``context`` words before it is left out of the first order, as its neighbour on that side has the same
documents and matches; likewise for the second order and the words from there on.

Sharing beyond ``tail`` words is ranked by whole runs; there, the other order tells the words apart.  A pair
whose match is neither the longest to the right nor to the left at any position is found only as the parts
that other documents share; words at an end can be missed where a match longer on that side is too short.  The order takes 16 bits of a word's hash, the matches 32.

Words are runs between ASCII white space with A-Z lower-cased.  Passages repeated inside one document only
are not reported.  Null and empty texts have no passages; copies match over their whole length; an empty
table gives no rows.  Rows that repeat doc_id and text are one document; rows that share a doc_id only are
told apart by their texts and match each other; a null doc_id is an id like others.  Other columns are not
read.  Shuffle files of written stages are freed, as the peak of disk use counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .chosen_path import WORDS, _FOLD, mixed

GRAM, WINDOW, PREFIX, MIN_WORDS = 5, 20, 25, 50
#: Words of the order that are told apart one by one, after the prefix and before it.
TAIL = 32
#: Words around a position in which the next kept position on that side, its window and its prefix lie.
CONTEXT = 40


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _FOLD + h[k : len(h) - n + 1 + k]
    return mixed(out)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """As ``rolled`` in the logarithm of n steps, for runs of 2 ** k * 5 words; other hashes, 32 bits."""
    out, size = rolled(h, 5), 5
    while size < n and len(out):
        out = out[:-size] * _FOLD + mixed(out[size:]) if len(out) > size else out[:0]
        size *= 2
    return mixed(out) >> np.uint64(32)


def contexts(h: np.ndarray, at: np.ndarray, doc_id: int) -> np.ndarray:
    """Hashes of the ``CONTEXT`` words before each position (high half) and of five more from it on (low half).

    Where there are fewer, the document's own mark stands instead, which differs from every other's.
    """
    runs = run_hashes(h, CONTEXT)
    out = np.full((2, len(at)), mixed(np.array([doc_id]).view(np.uint64))[0] >> np.uint64(32), np.uint64)
    before, after = at >= CONTEXT, at + CONTEXT + 5 <= len(h)
    out[0, before], out[1, after] = runs[at[before] - CONTEXT], mixed(runs[at[after]] * _FOLD + runs[at[after] + 5]) >> np.uint64(32)
    return ((out[0] << np.uint64(32)) | out[1]).view(np.int64)


def kept_positions(h: np.ndarray) -> np.ndarray:
    """Minimiser positions that have ``PREFIX`` words from there on."""
    grams = rolled(h, GRAM)
    if len(h) < PREFIX or not len(grams):
        return np.empty(0, np.int64)
    if len(grams) <= WINDOW:
        at = np.array([int(np.argmin(grams))])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return at[at + PREFIX <= len(h)]


def _suffixes(batches):
    for batch in batches:
        key, ids, pos, context = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), shared.utf8_rows(batch.column(1))):
            h = word_hashes(bytes(text))
            at = kept_positions(h)
            if len(at):
                key.append(rolled(h, PREFIX)[at])
                ids.append(np.full(len(at), i, np.int64))
                pos.append(at)
                context.append(contexts(h, at, i))
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(context))], names=["key", "id", "pos", "context"])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def tails(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the next ``TAIL`` words one by one, then hashes of runs, each half as long as all before it.

    Rows of 16-bit numbers, zero beyond the text, and how many of them each row needs.
    """
    n = len(h)
    short = np.concatenate([(h >> np.uint32(16)).astype(np.uint16), np.zeros(TAIL, np.uint16)])
    out = [short[at[:, None] + np.arange(TAIL)]]
    power, back = (np.cumprod(np.full(n + 1, x, np.uint64)) for x in (_BASE, _BACK))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.astype(np.uint64) * power[:n])])
    left = n - at
    used, done = np.minimum(left, TAIL), TAIL
    while done < left.max(initial=0):
        upto = done + done // 2
        s, e = np.minimum(at + done, n), np.minimum(at + upto, n)
        out.append(np.where(s < e, (mixed((total[e] - total[s]) * back[s]) >> np.uint64(48)).astype(np.uint16), 0)[:, None])
        used += s < e
        done = upto
    return np.concatenate(out, axis=1), used


def _binary(rows: np.ndarray, used: np.ndarray) -> pa.Array:
    """Each row's first numbers as bytes that sort as they do."""
    data = rows.astype(">u2")[np.arange(rows.shape[1]) < used[:, None]]
    offsets = np.concatenate([[0], np.cumsum(2 * used)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ordered(batches):
    """Both directions of each shared position: a key for the words from there on and what follows them or stands before, in order."""
    for batch in batches:
        for i, places, words in zip(batch.column(0).to_pylist(), batch.column(1), shared.utf8_rows(batch.column(2))):
            h = np.frombuffer(words, np.uint32)
            worth = 10_000 * len(places) // len(h)
            key, pos, ahead, back = (places.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for used, way, side, at in ((ahead, key, h, pos + PREFIX), (back, key ^ 1, h[::-1], len(h) - pos)):
                if used.any():
                    rows = _binary(*tails(side, at[used].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(way[used]), rows, pa.array(np.full(len(rows), i, np.int64)), pa.array(pos[used]), pa.array(np.full(len(rows), worth, np.int32))], names=["key", "tail", "id", "pos", "worth"])


#: Rows of the order that are compared at once.
CHUNK = 30_000


def _chunks(batches):
    """Tables of ``CHUNK`` rows or more, and whether they are the last."""
    held, n = [], 0
    for batch in batches:
        if n >= CHUNK:
            yield pa.Table.from_batches(held), False
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held), True


def _shared(table: pa.Table) -> np.ndarray:
    """How many numbers of their tails each row and the next one share from the first on; -1 under different keys."""
    tail, key = table.column("tail").chunk(0), table.column("key").to_numpy()
    offsets = np.frombuffer(tail.buffers()[1], np.int32)[tail.offset : tail.offset + len(tail) + 1]
    used = np.diff(offsets) // 2
    rows = np.full((len(tail), int(used.max(initial=0)) + 1), -1, np.int32)
    rows[np.arange(rows.shape[1]) < used[:, None]] = np.frombuffer(tail.buffers()[2] or b"", np.uint16)[offsets[0] // 2 : offsets[-1] // 2]
    rows[:, -1] = np.arange(len(tail))
    return np.where(key[1:] == key[:-1], (rows[1:] != rows[:-1]).argmax(axis=1), -1)


class _Least:
    """Least values of ranges of an array, for many ranges at once."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            y, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(y[:-step], y[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over [first, last), which holds one at least."""
        out = np.empty(len(first), self.rows[0].dtype)
        level = np.frexp(last - first)[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][last[at] - (1 << k)])
        return out


def _around(least: _Least, at: np.ndarray, much: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows [first, last] that share ``much`` with the rows ``at``; ``least`` is of what neighbours share."""
    first, last = at.copy(), at.copy()
    for k in range(len(least.rows) - 1, -1, -1):
        row, step = least.rows[k], 1 << k
        can = first >= step
        can[can] = row[first[can] - step] >= much[can]
        first[can] -= step
        can = last + step <= len(least.rows[0])
        can[can] = row[last[can]] >= much[can]
        last[can] += step
    return first, last


def _partners(table: pa.Table, key, ids, pos, starts, stops, run, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs: each of the ``wanted`` rows with the two worthiest documents' of those that share most with it."""
    if len(key) < 2:
        return wanted[:0], wanted[:0]
    shared_ = _shared(table)
    least = _Least(shared_)
    much = np.full(len(wanted), -1)
    s, e = starts[run[wanted]], stops[run[wanted]]
    before, after = s > 0, e < len(key)
    much[before] = least.of(s[before] - 1, wanted[before])
    ahead = least.of(wanted[after], e[after])
    near = s - 1
    near[after] = np.where(ahead > much[after], e[after], near[after])
    much[after] = np.maximum(much[after], ahead)
    at, near, much = (x[much >= 0] for x in (wanted, near, much))
    first, last = _around(least, at, much)
    worth = table.column("worth").to_numpy().astype(np.int64)
    best = []
    for turned in (ids, ~ids):
        rank = np.empty(len(key), np.int64)
        order = np.lexsort((pos, turned, -worth))
        rank[order] = np.arange(len(key))
        best.append(order[_Least(rank).of(first, last + 1)])
    # Where a row is among the best itself, the nearest of another document is its other partner.
    x, y = np.concatenate([at, at, at]), np.concatenate([*best, near])
    other = ids[x] != ids[y]
    other[2 * len(at) :] &= ~(other[: len(at)] | other[len(at) : 2 * len(at)])
    return x[other], y[other]


def _neighbours(batches):
    """Every row with those of other documents that share most with it under its key.

    Rows of one document that stand together are a run.  Rows that may have nearer ones beyond the partition's
    bounds come out with edge set: the first and the last run, and one row of another document beside them.
    """
    held: pa.Table | None = None  # the last row of the run before, if its key is the same, and the run that may go on
    beside = first = False

    def edge(t, rows):
        rows = np.unique(np.array(rows, np.int64))
        ids, pos = t.column("id").take(rows), t.column("pos").take(rows)
        return _pairs(*(t.column(c).take(rows) for c in ("key", "tail", "worth")), ids, pos, ids, pos, True)

    for table, last in _chunks(batches):
        t = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        key, ids, pos = t.column("key").to_numpy(), t.column("id").to_numpy(), t.column("pos").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]))
        stops = np.append(starts[1:], len(key))
        run = np.repeat(np.arange(len(starts)), stops - starts)
        meets = key[starts[1:]] == key[starts[:-1]]  # run k and run k + 1 stand under one key
        whole = np.flatnonzero(((run > 0) | (not beside)) & ((run < len(starts) - 1) | last))
        yield _pairs(None, None, None, *_by_id(ids, pos, *_partners(t, key, ids, pos, starts, stops, run, whole)), False)
        if not first:
            first = len(starts) > 1 or last
            if first:
                yield edge(t, [*range(stops[0]), *([stops[0]] if len(meets) and meets[0] else [])])
        end = starts[-1]
        if last:
            yield edge(t, [*range(end, len(key)), *([end - 1] if len(meets) and meets[-1] else [])])
        else:
            beside = bool(len(meets) and meets[-1])
            held = t.slice(end - beside)


def _by_id(ids, pos, x, y):
    """The distinct pairs of rows, in each the lesser document first."""
    turn = ids[x] > ids[y]
    a, b = np.where(turn, y, x), np.where(turn, x, y)
    rows = np.stack([ids[a], pos[a], ids[b], pos[b]])
    rows = rows[:, np.lexsort(rows)]
    rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])[: rows.shape[1]]]
    return rows[0], rows[1].astype(np.int32), rows[2], rows[3].astype(np.int32)


def _pairs(key, tail, worth, a, i, b, j, edge: bool):
    n = len(a)
    own = [pa.nulls(n, k) if x is None else x for x, k in ((key, pa.int64()), (tail, pa.binary()), (worth, pa.int32()))]
    columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in (*own, a, i, b, j)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, edge))], names=["key", "tail", "worth", "a", "pa", "b", "pb", "edge"])


PAIRS = "key long, tail binary, worth int, a long, pa int, b long, pb int, edge boolean"


def extended(x: np.ndarray, y: np.ndarray, i: int, j: int) -> tuple[int, int, int]:
    """Starts in both documents and the length of the match around (i, j)."""
    n = min(i, j)
    left = x[i - n : i][::-1] != y[j - n : j][::-1]
    back = int(np.argmax(left)) if left.any() else n
    m = min(len(x) - i, len(y) - j)
    right = x[i : i + m] != y[j : j + m]
    ahead = int(np.argmax(right)) if right.any() else m
    return i - back, j - back, back + ahead


def _matches(min_words: int):
    def run(batches):
        for batch in batches:
            out = set()
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, (places, s, t) in enumerate(zip(batch.column(2), shared.utf8_rows(batch.column(3)), shared.utf8_rows(batch.column(4)))):
                x, y = np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32)
                done: dict[int, list[tuple[int, int]]] = {}
                for i, j in zip(*(places.values.field(k).to_pylist() for k in (0, 1))):
                    spans = done.setdefault(i - j, [])
                    if any(s0 <= i < e0 for s0, e0 in spans):
                        continue
                    i0, j0, n = extended(x, y, i, j)
                    spans.append((i0, i0 + n))
                    if n >= min_words:
                        out.update(((a[r], i0, i0 + n, b[r]), (b[r], j0, j0 + n, a[r])))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start_word", "end_word", "other_id"])

    return run


def repeated_passages(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_id: passages that another document holds too."""
    base = shared.work_dir(spark, "suffix_dedup")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text").cast("string"))
    texts = docs.select(own.alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    suffixes = shared.saved(texts.select("id", "text").transform(shared.in_arrow, _suffixes, "key long, id long, pos int, context long"), f"{base}/suffixes")
    keys = shared.saved(suffixes.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.expr("bit_and(context) ^ bit_or(context)").alias("x")).where("a < b and x <> 0").select("key", F.expr("shiftrightunsigned(x, 32) <> 0").alias("ahead"), F.expr("x & 4294967295 <> 0").alias("back")), f"{base}/keys")
    met = suffixes.join(shared.small_side(keys, f"{base}/keys"), "key")
    places = shared.saved(met.groupBy("id").agg(F.collect_set(F.struct("key", "pos", "ahead", "back")).alias("places")), f"{base}/places")
    shared.delete(spark, f"{base}/suffixes")
    ids = shared.saved(places.select("id"), f"{base}/ids")

    def hashed(batches):
        for batch in batches:
            out = [(word_hashes(bytes(t)) >> np.uint64(32)).astype(np.uint32).tobytes() for t in shared.utf8_rows(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "doc_id", "h"])

    words = texts.join(shared.small_side(ids, f"{base}/ids"), "id", "left_semi").select("id", "doc_id", "text").transform(shared.in_arrow, hashed, "id long, doc_id long, h binary")
    words = shared.saved(words.dropDuplicates(["id"]), f"{base}/words")
    shared.free(spark)
    order = ["key", "tail", "id", "pos"]
    sides = places.join(words.select("id", "h").hint("merge"), "id").select("id", "places", "h").transform(shared.in_arrow, _ordered, "key long, tail binary, id long, pos int, worth int")
    sides = shared.saved(sides, f"{base}/tails")
    shared.free(spark)
    # Sorted before the shuffle too, as rows that share a passage then stand together and compress.
    ranged = sides.sortWithinPartitions(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pairs = shared.saved(ranged.transform(shared.in_arrow, _neighbours, PAIRS), f"{base}/pairs")
    del ranged
    shared.delete(spark, f"{base}/tails")
    shared.free(spark)
    # The places where the order was cut: a few rows of each partition.
    edges = pairs.where("edge").select("key", "tail", F.col("a").alias("id"), F.col("pa").alias("pos"), "worth").coalesce(1).sortWithinPartitions(*order).transform(shared.in_arrow, _neighbours, PAIRS)
    both = pairs.where("not edge").unionByName(edges.where("not edge"))
    by_docs = shared.saved(both.groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb")).alias("places")), f"{base}/by_docs")
    shared.delete(spark, f"{base}/pairs")
    shared.free(spark)
    left, right = (words.select(F.col("id").alias(c), F.col("doc_id").alias(f"{c}_doc"), F.col("h").alias(f"{c}_h")).hint("merge") for c in "ab")
    met = by_docs.join(left, "a").join(right, "b").select("a_doc", "b_doc", "places", "a_h", "b_h").transform(shared.in_arrow, _matches(min_words), "doc_id long, start_word long, end_word long, other_id long")
    return met.groupBy("doc_id", "start_word", "end_word").agg(F.min("other_id").alias("other_id")).withColumn("n_words", F.col("end_word") - F.col("start_word"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
