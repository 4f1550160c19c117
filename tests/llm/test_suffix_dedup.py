"""Repeated passages against brute force."""

import random

from siftmill.llm.suffix_dedup import repeated_passages

from .conftest import ODD


def test_passages(spark, docs):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(100000)}"
    passage, short = [word() for _ in range(60)], [word() for _ in range(20)]
    rows = []
    for k in range(30):
        head, tail = [word() for _ in range(rng.randrange(0, 90))], [word() for _ in range(rng.randrange(0, 90))]
        middle = passage if k % 3 == 0 else short if k % 3 == 1 else []
        rows.append((k, " ".join(head + middle + tail), "s"))
    starts = {k: next(i for i in range(len(t.split())) if t.split()[i : i + 60] == passage) for k, t, _ in rows if k % 3 == 0}
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(spark, docs(rows + [(100 + i, t, "s") for i, t in enumerate(ODD)])).collect()}
    assert got == {(k, s, s + 60) for k, s in starts.items()}
    assert repeated_passages(spark, docs([])).count() == 0


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_every_occurrence(spark, docs):
    rng = random.Random(5)
    passage, rows, want = words(rng, 60), [], set()
    for k, times in ((1, 3), (2, 1), (3, 2)):
        text = []
        for _ in range(times):
            text += words(rng, 70)
            want.add((k, len(text), len(text) + 60))
            text += passage
        rows.append((k, " ".join(text + words(rng, 30)), "s"))
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(spark, docs(rows)).collect()}
    assert got == want


def test_longest_among_almost_equal(spark, docs):
    """Documents that share all but the first or the last word stand between those that share all."""
    rng = random.Random(8)
    rows, want = [], set()
    for k in range(40):
        p = words(rng, 50)
        for j, part in enumerate((p, p[:49] if k % 2 else p[1:], p)):
            head = words(rng, 30)
            rows.append((3 * k + j, " ".join(head + part + words(rng, 30)), "s"))
            if j != 1:
                want.add((3 * k + j, 30, 80))
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(spark, docs(rows)).collect()}
    assert got == want


def test_neighbours_across_bounds(monkeypatch):
    """In one piece, in chunks or cut anywhere: every row meets one of another document that shares most with it."""
    import pyarrow as pa

    from siftmill.llm import suffix_dedup
    from siftmill.llm.suffix_dedup import _neighbours

    kinds = {"key": pa.int64(), "tail": pa.binary(), "id": pa.int64(), "pos": pa.int32(), "worth": pa.int32()}

    def run(rows, size=100):
        cut = [rows[k : k + size] for k in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds.values())], names=list(kinds)) for part in cut]
        out = [r for b in _neighbours(iter(batches)) for r in b.to_pylist()]
        return {(r["a"], r["pa"], r["b"], r["pb"]) for r in out if not r["edge"]}, sorted({(r["key"], r["tail"], r["a"], r["pa"], r["worth"]) for r in out if r["edge"]})

    def much(x, y):
        s, t = ([r[1][k : k + 2] for k in range(0, len(r[1]), 2)] for r in (x, y))
        return next((k for k, (p, q) in enumerate(zip(s, t)) if p != q), min(len(s), len(t)))

    def good(rows, pairs):
        row = {(r[2], r[3]): r for r in rows}
        for x in rows:
            others = [y for y in rows if y[0] == x[0] and y[2] != x[2]]
            met = [row[q if p == (x[2], x[3]) else p] for p, q in ((r[:2], r[2:]) for r in pairs) if (x[2], x[3]) in (p, q)]
            assert all(y[0] == x[0] and y[2] != x[2] for y in met)
            if others:
                assert max(much(x, y) for y in met) == max(much(x, y) for y in others)

    rng = random.Random(2)
    for _ in range(300):
        rows = sorted((rng.randrange(2), bytes(rng.randrange(2) for _ in range(2 * rng.randrange(4))), (i := rng.randrange(5)), p, i // 2) for p in range(14))
        pairs, edges = run(rows)
        good(rows, pairs)
        assert len(pairs) <= 2 * len(rows)
        monkeypatch.setattr(suffix_dedup, "CHUNK", rng.randrange(1, 6))
        good(rows, run(rows, rng.randrange(1, 4))[0])
        monkeypatch.undo()
        cuts = sorted(rng.sample(range(15), 3))
        parts = [run(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, 14])]
        good(rows, set().union(*(p[0] for p in parts), run(sorted({e for p in parts for e in p[1]}))[0]))


def test_against_all_pairs(spark, docs):
    """Every reported passage is a whole match of two documents; every match of two documents is covered.

    But for a word or two at an end: where the longest match to one side is too short in all, it hides the next.
    """
    rng = random.Random(12)
    shared = [words(rng, n) for n in (60, 80, 55, 120, 50, 49)]
    texts = []
    for _ in range(60):
        text = words(rng, rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 4)):
            p = list(rng.choice(shared))
            a, b = rng.randrange(0, 12), len(p) - rng.randrange(0, 12)
            text += p[a:b] + words(rng, rng.randrange(1, 30))
        texts.append(text)
    texts.append(list(texts[0]))
    whole = {}  # (document, start, end) -> others
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            if i != j:
                for s in range(len(x)):
                    for t in range(len(y)):
                        if x[s] == y[t] and (not s or not t or x[s - 1] != y[t - 1]):
                            n = 0
                            while s + n < len(x) and t + n < len(y) and x[s + n] == y[t + n]:
                                n += 1
                            if n >= 50:
                                whole.setdefault((i, s, s + n), set()).add(j)
    got = repeated_passages(spark, docs([(k, " ".join(t), "s") for k, t in enumerate(texts)])).collect()
    assert got and all(r.other_id in whole.get((r.doc_id, r.start_word, r.end_word), ()) for r in got)
    covered = {(r.doc_id, k) for r in got for k in range(r.start_word, r.end_word)}
    assert covered <= {(i, k) for i, s, e in whole for k in range(s, e)}
    assert all(sum((i, k) not in covered for k in range(s, e)) <= 2 for i, s, e in whole)
    assert len({(i, k) for i, s, e in whole for k in range(s, e)} - covered) < 0.005 * len(covered)


def test_rows_that_share_a_doc_id(spark, docs):
    rng = random.Random(6)
    p, q = words(rng, 60), words(rng, 70)
    rows = [(1, " ".join(p + words(rng, 9)), "s"), (1, " ".join(words(rng, 5) + q), "s"), (2, " ".join(words(rng, 3) + p), "s"), (None, " ".join(q), "s"), (2**62, " ".join(words(rng, 4) + q), "s")]
    d = docs(rows + rows[:1]).selectExpr("*", "1 as id", "2 as key", "3 as pos", "'x' as h")
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(spark, d).collect()}
    assert got == {(1, 0, 60), (1, 5, 75), (2, 3, 63), (None, 0, 70), (2**62, 4, 74)}


def test_long_text(spark, docs):
    rng = random.Random(9)
    long = words(rng, 30_000)
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeated_passages(spark, docs([(1, " ".join(long), "s"), (2, " ".join(words(rng, 100) + long[7:29_000]), "s")])).collect()}
    assert got == {(1, 7, 29_000), (2, 100, 29_093)}
