"""MinHash near-dedup by a chosen-path set similarity join (Christiani and Pagh, 2017; CPSJoin, 2018).

Documents are sets of distinct word shingles.  Rows with equal sets form a class, and one row stands for
it.  Independent trees branch these rows: every node picks one or, at times, two of the minhash
coordinates (1 / threshold on average), and rows that agree there go on together.  A node of at most
``small`` rows is compared exhaustively by its sketches; a larger one branches again, up to ``depth``
times.  Candidates are confirmed on full sets, and confirmed links are joined to components.

Nodes that stay large hold true groups of near copies.  They are first joined through leaders: a row that
is like a leader is linked to it and to no other, block by block, so a group of n near copies makes about
n candidates.  After these links are confirmed, rows of large nodes are dealt to blocks anew and compared
across components; at last every pair of rows in a node that is still in different components is compared,
so no link is lost to the short cuts.

Null, empty and white-space-only texts have an empty set and link with nothing.  A text of fewer than
``width`` words is one shingle.  Repeated rows are members of the same class.  A row without a doc_id is
a member of the class of its equals, which it never stands for; alone it has no component and is kept.
Only doc_id and text are read, so other columns may have any name.  An empty table gives no rows.  Words
are bytes of UTF-8 between ASCII white space, with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from . import shared
from .components import connected_components

COORDINATES = 128
#: Sketches that agree on less than threshold - SLACK are no candidates: more than four standard errors at 128 coordinates.
SLACK = 0.13
SMALL, BLOCK = 64, 256
#: Bytes of sets that a block of a large node holds, if blocks of ``BLOCK`` rows are not larger already.
BLOCK_BYTES = 16 << 20
#: Times that the rows of a large node are dealt to blocks before blocks of different components are compared.
DEALS = 2
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
#: Word hashes that a worker remembers.
REMEMBERED = 120_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


WORDS = _Words()
shared.FORGET.append(WORDS.clear)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _FOLD + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


_COEFFICIENTS = [np.random.default_rng(k).integers(0, 2**64, COORDINATES, np.uint64) | np.uint64(k == 11) for k in (11, 12)]


def minhashes(found: np.ndarray) -> np.ndarray:
    """The least of each coordinate's 32-bit hashes over a set; long sets go through in pieces."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    a, b = (x[:, None] for x in _COEFFICIENTS)
    for at in range(0, len(found), 2048):
        out = np.minimum(out, ((found[None, at : at + 2048] * a + b) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def children(nodes: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and nodes one level below: a node's own hash picks its coordinates."""
    rows = np.arange(len(nodes))
    first = (nodes % np.uint64(COORDINATES)).astype(np.int64)
    second = ((nodes >> np.uint64(40)) % np.uint64(COORDINATES)).astype(np.int64)
    two = (((nodes >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) < (1 / threshold - 1) * 65536) & (first != second)

    def below(r, c):
        return mixed(nodes[r] * _FOLD + mixed(sketches[r, c].astype(np.uint64) + (c.astype(np.uint64) << np.uint64(32)) + _GOLD))

    return np.concatenate([rows, rows[two]]), np.concatenate([below(rows, first), below(rows[two], second[two])])


def _matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(shared.utf8_rows(column)), dtype).reshape(-1, width)


def _runs(batches, keys: int):
    """Batches that are sorted by their first ``keys`` columns (longs), cut so that no key is split."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        other = np.zeros(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            other |= column != column[-1]
        at = np.flatnonzero(other)
        last = int(at[-1]) + 1 if len(at) else 0  # where the last run begins
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


class _Like:
    """Whether two rows can be similar: by the sizes of their sets exactly, by their sketches with slack."""

    def __init__(self, sizes: np.ndarray, shorts: np.ndarray, threshold: float):
        self.sizes, self.shorts, self.threshold = sizes, shorts, threshold
        self.least = (threshold - SLACK) * 255 / 256 + 1 / 256

    def __call__(self, a, b) -> np.ndarray:
        x, y = self.sizes[a], self.sizes[b]
        fits = np.minimum(x, y) >= self.threshold * np.maximum(x, y) - 1e-9
        return fits & ((self.shorts[a] == self.shorts[b]).mean(axis=-1) >= self.least)


def _leaders(rows: np.ndarray, like: _Like) -> tuple[list, list]:
    """Each row, in order, is linked to the first leader that it is like, or leads itself."""
    a, b = [], []
    while len(rows) > 1:
        rest = rows[1:]
        ok = like(rows[0], rest)
        b.extend(rest[ok].tolist())
        a.extend([rows[0]] * int(ok.sum()))
        rows = rest[~ok]
    return a, b


def _led(batches, threshold: float):
    """Round one: (a, b) for a row like its leader, in a small node or in a block of a large one."""
    for t in _runs(batches, 2):
        node, slot, ids = (t.column(k).to_numpy() for k in range(3))
        like = _Like(t.column(3).to_numpy(), _matrix(t.column(4), np.uint8, COORDINATES), threshold)
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (slot[1:] != slot[:-1])) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(node)]])
        pair = starts[(stops - starts) == 2]
        ok = like(pair, pair + 1) if len(pair) else np.empty(0, bool)
        a, b = pair[ok].tolist(), (pair[ok] + 1).tolist()
        for s, e in zip(starts.tolist(), stops.tolist()):
            if e - s > 2:
                x, y = _leaders(np.arange(s, e), like)
                a += x
                b += y
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(ids[a]), pa.array(ids[b])], names=["node", "a", "b"])


def _crossed(batches, threshold: float, pct: int):
    """Confirmed (a, b) between different components, in a block of a node or between two of them, with these components.

    Likeliest pairs come first, and a pair whose components have been joined meanwhile needs no look, so a
    task gives back at most one link for each component that it joins, whatever the number of pairs.
    """
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while (d := joined.get(c, c)) != c:
            c = d
        return c

    for t in _runs(batches, 3):
        node, i, j, side, ids, comp = (t.column(k).to_numpy() for k in range(6))
        like = _Like(t.column(6).to_numpy(), _matrix(t.column(7), np.uint8, COORDINATES), threshold)
        found = shared.utf8_rows(t.column(8))
        cuts = np.flatnonzero((node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        a, b, c, d = [], [], [], []
        for s, e in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(node)]]).tolist()):
            now = np.array([root(c) for c in comp[s:e].tolist()])
            if (now == now[0]).all():
                continue
            rows, same = np.arange(s, e), i[s] == j[s]
            left = rows if same else rows[side[s:e] == 0]
            right = rows if same else rows[side[s:e] == 1]
            for r in left.tolist():
                others = right[(now[right - s] != now[r - s]) & ((right > r) if same else True)]
                if not len(others):
                    continue
                others = others[like(r, others)]
                mine = np.frombuffer(found[r], np.uint64) if len(others) else None
                for o in others[np.argsort(-(like.shorts[others] == like.shorts[r]).sum(axis=1), kind="stable")].tolist():
                    if now[o - s] == now[r - s]:
                        continue
                    other = np.frombuffer(found[o], np.uint64)
                    if _similar(mine, other, pct):
                        a.append(int(ids[r])), b.append(int(ids[o])), c.append(int(now[r - s])), d.append(int(now[o - s]))
                        joined[int(now[o - s])] = int(now[r - s])
                        now[now == now[o - s]] = now[r - s]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c, d)], names=["a", "b", "c", "d"])


def _similar(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= pct * (len(x) + len(y) - both)


class ChosenPathJoin:
    def __init__(self, spark: SparkSession, docs: DataFrame, threshold_pct: int = 85, width: int = 5, trees: int = 10, depth: int = 4):
        self.spark, self.width, self.pct, self.threshold, self.trees, self.depth = spark, width, threshold_pct, threshold_pct / 100, trees, depth
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.base = shared.work_dir(spark, "chosen_path")

    # -- one row per class of equal sets

    def sketch(self) -> None:
        width = self.width

        def run(batches):
            for batch in batches:
                n, key, sketch = [], [], []
                for text in shared.utf8_rows(batch.column(1)):
                    found = shingles(bytes(text), width)
                    n.append(len(found))
                    key.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                    sketch.append(minhashes(found) if len(found) else np.zeros(COORDINATES, np.uint32))
                short = [(x & np.uint32(255)).astype(np.uint8).tobytes() for x in sketch]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(short, pa.binary())], names=["doc_id", "n", "key", "sketch", "short"])

        all_rows = self.docs.transform(shared.in_arrow, run, "doc_id long, n long, key binary, sketch binary, short binary")
        self.sketched = shared.saved(all_rows, f"{self.base}/sketches")
        self.classes = shared.saved(self.sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id")), f"{self.base}/classes")
        one = self.sketched.where("key is not null").join(self.classes.withColumnRenamed("key", "k").hint("merge"), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("id"))).groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short"))
        self.reps = shared.saved(one, f"{self.base}/reps")

    # -- the trees

    def grow(self) -> None:
        """self.nodes: (node, id, size) of all nodes that are compared."""
        threshold, trees = self.threshold, self.trees
        roots = mixed(np.arange(1, trees + 1, dtype=np.uint64) * _GOLD)

        def emit(r, below, ids):
            return pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), pa.array(ids[r])], names=["node", "id"])

        def first(batches):
            for batch in batches:
                ids, s = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32, COORDINATES)
                for root in roots:
                    yield emit(*children(np.full(len(ids), root), s, threshold), ids)

        def later(batches):
            for batch in batches:
                node, ids, s = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), _matrix(batch.column(2), np.uint32, COORDINATES)
                yield emit(*children(node, s, threshold), ids)

        rows, done = self.reps.select("id", "sketch").transform(shared.in_arrow, first, "node long, id long"), []
        for level in range(1, self.depth + 1):
            rows = shared.saved(rows, f"{self.base}/level{level}")
            sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select(F.col("node").alias("at"), "size")
            live = shared.saved(rows.join(sizes.hint("merge"), F.col("node") == F.col("at")).drop("at"), f"{self.base}/live{level}")
            shared.delete(self.spark, f"{self.base}/level{level}")
            done.append(live if level == self.depth else live.where(F.col("size") <= SMALL))
            large = live.where(F.col("size") > SMALL)
            if level == self.depth or not large.limit(1).count():
                break
            rows = large.select("node", "id").join(self.reps.select("id", "sketch").hint("merge"), "id").select("node", "id", "sketch").transform(shared.in_arrow, later, "node long, id long")
        nodes = done[0]
        for x in done[1:]:
            nodes = nodes.unionByName(x)
        self.nodes = nodes

    def _with_short(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.reps.select("id", "n", "short").hint("merge"), "id")

    def lead(self) -> DataFrame:
        threshold = self.threshold
        slot = F.when(F.col("size") > SMALL, F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK).cast("long"))).otherwise(F.lit(0).cast("long"))
        full = self._with_short(self.nodes.withColumn("slot", slot)).select("node", "slot", "id", "n", "short")
        return full.repartition("node", "slot").sortWithinPartitions("node", "slot", "id").transform(shared.in_arrow, lambda b: _led(b, threshold), "node long, a long, b long")

    def sets(self, ids: DataFrame, path: str) -> DataFrame:
        """(id, found): full sets of some rows; only their texts are read again."""
        width = self.width

        def run(batches):
            for batch in batches:
                out = [shingles(bytes(x), width).tobytes() for x in shared.utf8_rows(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxh3_128_digest(x) for x in out], pa.binary()), pa.array(out, pa.binary())], names=["id", "key", "found"])

        ids = shared.saved(ids.select(F.col("id").alias("doc_id")).distinct(), f"{path}-ids")
        full = self.docs.join(shared.small_side(ids, f"{path}-ids"), "doc_id", "left_semi").select("doc_id", "text").transform(shared.in_arrow, run, "id long, key binary, found binary")
        # Of rows that share a doc_id, the class that it stands for has the right set.
        full = full.join(self.classes.withColumnRenamed("id", "rep"), "key", "left_semi")
        return shared.saved(full.dropDuplicates(["id", "key"]).select("id", "found"), f"{path}-sets")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets are similar."""
        pct, path = self.pct, f"{self.base}/{name}"

        def compare(batches):
            for batch in batches:
                keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), pct) for x, y in zip(shared.utf8_rows(batch.column(2)), shared.utf8_rows(batch.column(3)))]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        pairs = shared.saved(pairs, f"{path}-pairs")
        full = self.sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), path)
        left, right = (full.select(F.col("id").alias(c), F.col("found").alias(f"{c}_found")).hint("merge") for c in "ab")
        links = shared.saved(pairs.join(left, "a").join(right, "b").select("a", "b", "a_found", "b_found").transform(shared.in_arrow, compare, "a long, b long"), f"{path}-links")
        shared.delete(self.spark, f"{path}-sets")
        return links

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Confirmed links, enough to join what is similar, and the components of their ends."""
        led = shared.saved(self.lead(), f"{self.base}/led")
        links = self.confirmed(led.select("a", "b").distinct(), "led")
        groups = connected_components(self.spark, links)
        more = self.crossing(led, groups)
        if not more.limit(1).count():
            return links, groups
        links = links.unionByName(more)
        return links, connected_components(self.spark, links)

    def crossing(self, led: DataFrame, groups: DataFrame) -> DataFrame:
        """Confirmed links between different components of a node: every such pair is compared, or joined before its turn.

        A node needs no look if leaders have joined it, or if it is small and none of its rows was set aside for
        a leader.  Rows of large nodes are dealt to blocks by changing hashes ``DEALS`` times and compared there,
        which joins a group of near copies at the cost of a few rows each.  What is still apart afterwards is cut
        into blocks of one component each, the small ones together, and only blocks of different components meet.
        A block grows with the root of its node's size, so n rows that are all apart make about n * sqrt(n / BLOCK)
        rows and not n * n / BLOCK; a component of n rows and k others make about n + k * n / block.
        """
        path = f"{self.base}/crossing"
        touched = led.select(F.col("node").alias("at")).distinct()
        small = self.nodes.where(F.col("size") <= SMALL).join(touched.hint("merge"), F.col("node") == F.col("at"), "left_semi")
        members = self.nodes.where(F.col("size") > SMALL).unionByName(small).distinct()
        labelled = members.join(groups.select(F.col("id").alias("of"), "component_id").hint("merge"), F.col("id") == F.col("of"), "left").select("node", "size", "id", F.coalesce("component_id", "id").alias("comp"))
        rows = self._apart(labelled, f"{path}-rows")
        full = self.sets(rows.select("id"), path)
        links: list[DataFrame] = []
        for k in range(1, DEALS + 1):
            large = rows.where(F.col("size") > SMALL)
            if not large.limit(1).count():
                break
            block = F.pmod(F.xxhash64(F.lit(k), "id"), F.ceil(F.col("size") / BLOCK).cast("long"))
            dealt = large.select("node", block.alias("i"), block.alias("j"), F.lit(0).cast("long").alias("side"), "id", "comp")
            links.append(self._compared(dealt, full, f"{path}-dealt{k}"))
            if not links[-1].limit(1).count():
                break
            joined = connected_components(self.spark, links[-1], "c", "d").select(F.col("id").alias("of"), F.col("component_id").alias("now"))
            rows = self._apart(rows.join(joined.hint("merge"), F.col("comp") == F.col("of"), "left").select("node", "size", "id", F.coalesce("now", "comp").alias("comp")), f"{path}-rows{k}")
        links.append(self._compared(self._cut(rows, full, path), full, f"{path}-cut"))
        shared.delete(self.spark, f"{path}-sets")
        out = links[0]
        for more in links[1:]:
            out = out.unionByName(more)
        return out.select("a", "b")

    def _apart(self, labelled: DataFrame, path: str) -> DataFrame:
        """The rows of nodes that hold more than one component; trees meet the same rows again and again, so of nodes with equal members one."""
        labelled = shared.saved(labelled, f"{path}-labelled")
        nodes = labelled.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.bit_xor(F.xxhash64("id")).alias("sig"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("sig2"), F.count("*").alias("members")).where("x <> y")
        nodes = nodes.groupBy("sig", "sig2", "members").agg(F.min("node").alias("at")).select("at")
        rows = shared.saved(labelled.join(nodes.hint("merge"), F.col("node") == F.col("at"), "left_semi"), path)
        shared.delete(self.spark, f"{path}-labelled")
        return rows

    def _cut(self, rows: DataFrame, full: DataFrame, path: str) -> DataFrame:
        """(node, i, j, side, id, comp): every row once for each block that its block is compared with."""
        zero = F.lit(0).cast("long")
        small = rows.where(F.col("size") <= SMALL).select("node", zero.alias("i"), zero.alias("j"), zero.alias("side"), "id", "comp")
        large = rows.where(F.col("size") > SMALL)
        if not large.limit(1).count():
            return small
        weights = full.select(F.col("id").alias("of"), F.length("found").alias("bytes"))
        counted = large.join(weights.hint("merge"), F.col("id") == F.col("of")).groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
        counted = shared.saved(counted, f"{path}-counted")
        # Few large blocks make few copies of a row: a block has the root of its node's size, as far as its sets' bytes allow.
        fits = F.floor(F.lit(BLOCK_BYTES) * F.sum("c") / F.sum("bytes"))
        block = F.greatest(F.lit(BLOCK), F.least(BLOCK * F.ceil(F.sqrt(F.sum("c") / BLOCK)), fits)).cast("long")
        blocks = counted.groupBy("node").agg(block.alias("block")).select(F.col("node").alias("bn"), "block")
        # A unit is a component of a block's size or more, or all the smaller ones of a node: unit 0.
        parts = counted.join(blocks.hint("merge"), F.col("node") == F.col("bn")).select("node", "comp", "c", "block", F.when(F.col("c") >= F.col("block"), F.xxhash64("comp")).otherwise(0).alias("u"))
        parts = shared.saved(parts, f"{path}-parts")
        units = shared.saved(parts.groupBy("node", "u").agg(F.ceil(F.sum("c") / F.first("block")).cast("long").alias("blocks")), f"{path}-units")
        mine = units.select("node", "u", F.col("blocks").alias("own"))
        other = units.select(F.col("node").alias("at"), F.col("u").alias("v"), F.col("blocks").alias("theirs"))
        meets = mine.join(other.hint("merge"), (F.col("node") == F.col("at")) & ((F.col("u") != F.col("v")) | (F.col("u") == 0)))
        meets = shared.saved(meets.select(F.col("node").alias("at"), F.col("u").alias("unit"), "v", "own", "theirs"), f"{path}-meets")
        placed = large.join(parts.select(F.col("node").alias("pn"), F.col("comp").alias("pc"), "u").hint("merge"), (F.col("node") == F.col("pn")) & (F.col("comp") == F.col("pc")))
        placed = placed.select("node", "u", "id", "comp").join(meets.hint("merge"), (F.col("node") == F.col("at")) & (F.col("u") == F.col("unit")))
        placed = placed.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("own"))).withColumn("facing", F.explode(F.sequence(zero, F.col("theirs") - 1)))
        first = F.struct(F.col("u"), F.col("slot")) <= F.struct(F.col("v").alias("u"), F.col("facing").alias("slot"))
        near, far = F.xxhash64("u", "slot"), F.xxhash64("v", "facing")
        cut = placed.select("node", F.when(first, near).otherwise(far).alias("i"), F.when(first, far).otherwise(near).alias("j"), F.when(first, 0).otherwise(1).cast("long").alias("side"), "id", "comp")
        return small.unionByName(cut)

    def _compared(self, cut: DataFrame, full: DataFrame, path: str) -> DataFrame:
        """Links (a, b) found in blocks, with the components (c, d) that they join.

        Sketches and sets are joined to an id once, with all its places in blocks, and go to these places afterwards.
        """
        threshold, pct = self.threshold, self.pct
        places = cut.groupBy("id").agg(F.collect_list(F.struct("node", "i", "j", "side", "comp")).alias("places"))
        whole = self._with_short(places).join(full.hint("merge"), "id").withColumn("place", F.explode("places")).select("place.node", "place.i", "place.j", "place.side", "id", "place.comp", "n", "short", "found")
        links = whole.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "id").transform(shared.in_arrow, lambda b: _crossed(b, threshold, pct), "a long, b long, c long, d long")
        return shared.saved(links.distinct(), path)

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept: one row per row of the table."""
        self.sketch()
        self.grow()
        _, groups = self.links()
        by_class = self.classes.join(groups.withColumnRenamed("id", "of").hint("merge"), F.col("id") == F.col("of"), "left").select(F.col("key").alias("k"), F.coalesce("component_id", "id").alias("component_id"))
        rows = self.sketched.select("doc_id", "n", "key").join(by_class.hint("merge"), F.col("key") == F.col("k"), "left")
        component = F.coalesce("component_id", "doc_id")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, threshold_pct: int = 85, width: int = 5, trees: int = 10) -> DataFrame:
    return ChosenPathJoin(spark, docs, threshold_pct, width, trees).result()


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
