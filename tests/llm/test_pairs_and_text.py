"""Exact dedup, line dedup, BPE and embeddings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftmill.llm import bpe, exact_dedup, line_dedup, shared
from siftmill.llm.embedding_dedup import near_vectors, plan

from .conftest import ODD

WS = str.maketrans("", "", " \t\n\x0b\x0c\r")
TEXTS = [*ODD, "Repeat me", "repeatme", "Repeat\nme ", "REPEAT ME", "no break", "a\x1cb c", "é é", "<|endoftext|> x<|startoftext|>y", "it's 'll 123 中文 \U0001f600!!", "İSTANBUL ΑΣ ΑΣ."]


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(WS), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        for _, i in members:
            out[i] = (min(members)[1], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda x: bytes([len(x) % 2])])
def test_exact_dedup(spark, docs, digest):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, docs([(i, t, None) for i, t in rows]), digest=digest).collect()}
    assert got == {i: (k, n, i == k) for i, (k, n, _) in exact(rows).items()}


def test_exact_dedup_of_repeated_rows_and_none(spark, docs):
    rows = [(7, "x y", "s"), (7, "x y", "s"), (3, "xy", "s")]
    got = exact_dedup.exact_dedup(spark, docs(rows)).collect()
    assert sum(r.kept for r in got) == 1 and {r.keep_id for r in got} == {7} and {r.group_size for r in got} == {3}
    assert exact_dedup.exact_dedup(spark, docs([])).count() == 0


def test_state_never_forgets(spark, docs):
    job = exact_dedup.StreamingDedup(spark)
    for rows in ([(1, "a b", "s"), (2, "c", "s")], [(3, "a  b", "s")], [(0, "ab", "s"), (4, "d", "s")]):
        job.ingest(docs(rows))
    got = {-r.best.neg_id: r.n for r in job.groups().collect()}
    assert got == {3: 3, 2: 1, 4: 1}


@pytest.mark.parametrize("few", [0, 1000])
def test_line_dedup(spark, docs, few):
    texts = [f"head\n  Common LINE \r\nown {k}\n\nrare {k // 3}\ncommon line" for k in range(12)] + ODD
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(spark, docs(texts), min_docs=10, broadcast_keys=few).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < 10]
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.line_dedup(spark, docs([])).count() == 0


def test_bpe_matches_the_library(spark, docs):
    path = bpe.default_tokenizer()
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in bpe.encode(docs(TEXTS), path, decoded=True, keep=("source",)).collect()}
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want and rows[i].n_tokens == len(want), t
        assert rows[i].decoded == library.decode(want, skip_special_tokens=False)
        assert rows[i].source == f"s{i % 3}"
    again = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs(TEXTS), path), path).collect()}
    assert again == {i: r.decoded for i, r in rows.items()}
    assert bpe.encode(docs([]), path).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x[100:160] = x[0] + 0.15 * rng.standard_normal((60, 16))  # a dense group
    x[160:170] = x[5]  # copies
    x[170] = 3 * x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [1.0] * 15 + [None]), (905, [1.0, 2.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    norm = np.linalg.norm(x, axis=1)
    near = x @ x.T >= 0.9 * norm[:, None] * norm[None]
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(comp[i], comp[near[i]].min(initial=comp[i])) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    want = {k: (int(near[k].sum()), int(comp[k]), bool(comp[k] == k)) for k in range(len(x))} | {k: (0, k, True) for k in range(900, 906)}
    assert got == want
    assert near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_plan_keeps_recall():
    for n in (0, 1, 10**3, 10**6, 10**9):
        bits, tables = plan(n, 0.9)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= 0.999


def test_shared_arrays(tmp_path):
    shared.write_array(f"file://{tmp_path}/a/b.npy", np.arange(5))
    assert shared.map_array(f"file://{tmp_path}/a/b.npy").tolist() == [0, 1, 2, 3, 4]


def test_line_dedup_same_rows_both_ways(spark, docs):
    """Repeated and null doc_ids lose the same lines, whichever way the keys go."""
    rows = [(k, f"often\nown {k}", "s") for k in range(10)] + [(1, "often\nunique first", "s"), (1, "unique second\noften", "s"), (1, "unique second\noften", "s"), (None, "often\nno id", "s"), (None, "none\noften", "s"), (2, None, "s"), (2, "", "s")]
    table = docs(rows)
    few, many = (sorted(line_dedup.line_dedup(spark, table, broadcast_keys=n).collect(), key=str) for n in (400_000, 0))
    assert few == many
    assert sorted(r.kept_text for r in many if r.doc_id is None) == ["no id", "none"]
    assert len(many) == len(rows)


def test_embeddings_at_any_scale(spark):
    """Of eight vectors none links at unit scale, and so at any other; copies at another scale do."""
    rng = np.random.default_rng(4)
    x = np.linalg.qr(rng.standard_normal((16, 16)))[0][:8]
    for scale in (1e-310, 1e-200, 1.0, 1e200):
        rows = [(k, (v * scale).tolist()) for k, v in enumerate(x)] + [(100, (x[3] * 1e-3).tolist())]
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert got == {k: (int(k == 3), k, True) for k in range(8)} | {100: (1, 3, False)}


def test_embeddings_of_floats_large_and_missing_ids(spark):
    v, w = [0.1, 0.2, 0.3], [0.3, -0.2, 0.1]
    rows = [(2**62 + 1, v, 1), (2**62 + 5, v, 1), (-(2**63), w, 1), (7, w, 1), (None, v, 1), (None, None, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket int").selectExpr("*", "1 as id", "2 as copies", "'x' as vec")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark, d).collect()), key=str)
    assert got == sorted([(2**62 + 1, 1, 2**62 + 1, True), (2**62 + 5, 1, 2**62 + 1, False), (-(2**63), 1, -(2**63), True), (7, 1, -(2**63), False), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_large_bucket_is_cut(spark):
    rng = np.random.default_rng(7)
    x = np.ones(8) + 0.02 * rng.standard_normal((2600, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = near_vectors(spark, rows).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2599, 0)} and len(got) == 2600


def test_state_lives_through_a_restart(spark, docs):
    folder = exact_dedup.StreamingDedup(spark).folder
    for part in (["a b", "c"], ["a  b", "d"], ["ab", "c "]):
        exact_dedup.StreamingDedup(spark, folder).ingest(docs([(len(part[0]) * 10 + k, t, "s") for k, t in enumerate(part)]))
    job = exact_dedup.StreamingDedup(spark, folder)
    digests = [r.digest for r in job.groups().collect()]
    assert len(digests) == len(set(digests)) == 3
    rows = [r.row for r in job.arrivals().collect()]
    assert len(rows) == len(set(rows)) == 6
    assert sorted(r.n for r in job.groups().collect()) == [1, 2, 3]


def test_exact_dedup_of_extreme_and_missing_ids(spark, docs):
    rows = [(-(2**63), "x y", "s"), (5, "xy", "s"), (None, "x y", "s"), (2**63 - 1, "x\ty", "s"), (None, "alone", "s")]
    d = docs(rows).selectExpr("*", "1 as file", "2 as row", "3 as digest", "4 as n", "5 as at_id")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, d).collect()}
    low = -(2**63)
    assert got == {(low, low, 4, True), (5, low, 4, False), (None, low, 4, False), (2**63 - 1, low, 4, False), (None, None, 1, True)}


LONG = " ".join(f"word{k % 5000}" for k in range(60_000))
CLASH = ("*", "1 as key", "2 as n", "'x' as id", "'y' as kept_text", "3 as n_lines", "'z' as gone", "4 as ids", "5 as n_tokens", "6 as decoded")


def test_long_texts_and_clashing_columns(spark, docs):
    rows = [LONG, "a\n" * 40_000, None, "", LONG, LONG]
    d = docs(rows).selectExpr(*CLASH)
    for n in (400_000, 0):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(spark, d, min_docs=3, broadcast_keys=n).collect()}
        assert got == {0: (1, 1, ""), 1: (40_001, 0, rows[1]), 2: (1, 0, ""), 3: (1, 0, ""), 4: (1, 1, ""), 5: (1, 1, "")}
    library = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r.doc_id: r.n_tokens for r in bpe.encode(d, bpe.default_tokenizer()).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(rows)}
