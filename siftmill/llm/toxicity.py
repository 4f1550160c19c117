"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make document scores.

Fitting takes a bounded sample of labelled documents, at most ``per_class`` toxic and ``CLEAN`` times
as many clean ones of at most ``max_chars`` characters, drawn by a hash of doc_id, of near copies one; the
field itself is fitted to at most ``windows`` windows of ``WINDOW`` tokens of each class, drawn from them.  Tokens are labelled from it: in toxic documents, a token is toxic if
its word or one of its prefixes is tied to toxic documents by a likelihood-ratio test, in each half of
the sample too.  The field has two
states, features for word and prefixes, a bias and transitions, fitted by gradient ascent on the exact
likelihood (forward-backward over all chains at once).  A logistic curve in the field's own evidence,
-log P(no toxic token), fitted to the sample's documents at the population's class rates, gives the score.

Scoring runs forward-backward over every whole text.  Tokens without features all have the same
potentials, so a run of them is a matrix power: the result is exact, and only tokens with features cost
time.  Spans are the runs of tokens whose toxic marginal is 0.5 or more, as character offsets.

Null and empty texts have no tokens: no evidence, the lowest score, no spans.  Without labelled
documents of both classes every score is the share of toxic labels (0.0 without labels).  Only doc_id and
text are read, and toxic of the labels, so other columns may have any name.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .chosen_path import minhashes, shingles

PER_CLASS, CLEAN, MAX_CHARS = 1500, 3, 20_000
#: Likelihood ratio and odds that tie a feature to toxic documents.
TIED, ODDS = 18.0, 6.0
WINDOW, WINDOWS = 40, 1500
#: Minhashes by which copies in the sample are told.
COPY_HASHES = 16
REMEMBERED = 120_000
_EDGES = b".,;:!?\"'()[]{}<>|*_-#%$&"
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def features(token: bytes) -> tuple[str, ...]:
    word = token.strip(_EDGES).decode(errors="replace").lower()
    return (f"w={word}", *(f"{k}={word[:k]}" for k in (4, 5, 6) if len(word) >= k)) if word else ()


class Field:
    """The fitted field: weights of features, bias, transitions, start, and the curve from evidence to score."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, start: np.ndarray, curve: tuple[float, float]):
        self.weights, self.bias, self.trans, self.start, self.curve = weights, float(bias), trans, start, curve
        self.seen: dict[bytes, float] = {}
        self.powers: dict[int, tuple[np.ndarray, float]] = {}
        self.plain: dict[int, float] = {}

    def __getstate__(self):
        return self.weights, self.bias, self.trans, self.start, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        """A worker keeps the field for later tasks, but not what it remembers of texts."""
        for kept in (self.seen, self.powers, self.plain):
            kept.clear()

    def emission(self, token: bytes) -> float:
        e = self.seen.get(token)
        if e is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            e = self.seen[token] = self.bias + sum(self.weights.get(f, 0.0) for f in features(token))
        return e

    def step(self, e: float) -> np.ndarray:
        return np.exp(self.trans + np.array([[0.0, e], [0.0, e]]))

    def power(self, n: int) -> tuple[np.ndarray, float]:
        """n steps over tokens without features: matrix and log scale."""
        if n not in self.powers:
            if n <= 1:
                m, s = (np.eye(2), 0.0) if n == 0 else (self.step(self.bias), 0.0)
            else:
                (a, x), (b, y) = self.power(n // 2), self.power(n - n // 2)
                m, s = a @ b, x + y
            top = m.max()
            self.powers[n] = (m / top, s + math.log(top))
        return self.powers[n]

    def evidence(self, tokens: list[bytes]) -> tuple[float, np.ndarray, np.ndarray]:
        """-log P(no toxic token), the places of tokens with features, and their toxic marginals."""
        n = len(tokens)
        none = np.empty(0)
        if not n:
            return 0.0, none, none
        e = np.fromiter(map(self.emission, tokens), np.float64, n)
        at = np.flatnonzero(e != self.bias)
        if not len(at) and n in self.plain:
            return self.plain[n], none, none
        stops = at if len(at) and at[0] == 0 else np.concatenate([[0], at])
        alpha, scale, kept = np.exp(self.start + np.array([0.0, e[0]])), 0.0, []
        last = 0
        for k in stops.tolist():
            if k:
                m, s = self.power(k - last - 1)
                alpha, scale = alpha @ m @ self.step(e[k]), scale + s
            top = alpha.max()
            alpha, scale = alpha / top, scale + math.log(top)
            kept.append(alpha)
            last = k
        m, s = self.power(n - 1 - last)
        log_z = math.log((alpha @ m).sum()) + scale + s
        clean = float(self.start[0] + (n - 1) * self.trans[0, 0])
        found = max(0.0, log_z - clean)
        if not len(at):
            if len(self.plain) < REMEMBERED:
                self.plain[n] = found
            return found, none, none
        beta, p = m @ np.ones(2), np.empty(len(stops))
        for i in range(len(stops) - 1, -1, -1):
            both = kept[i] * beta
            p[i] = both[1] / both.sum()
            if i:
                m, _ = self.power(int(stops[i] - stops[i - 1]) - 1)
                beta = m @ (self.step(e[stops[i]]) @ beta)
                beta = beta / beta.max()
        return found, at, p[-len(at) :]

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * math.log(evidence + 1e-9) + b))))

    def spans(self, text: bytes, at: np.ndarray, p: np.ndarray) -> list[dict]:
        hot = [(int(k), float(x)) for k, x in zip(at, p) if x >= 0.5]
        if not hot:
            return []
        places, want = {}, {k for k, _ in hot}
        for k, m in enumerate(_TOKEN.finditer(text)):
            if k in want:
                places[k] = m.span()
        out: list[dict] = []
        chars, byte, last = 0, 0, -2
        for k, x in hot:
            s, t = places[k]
            start = chars + len(text[byte:s].decode())
            chars = start + len(text[s:t].decode())
            byte = t
            if k == last + 1:
                out[-1] = {"start": out[-1]["start"], "end": chars, "p": max(x, out[-1]["p"])}
            else:
                out.append({"start": start, "end": chars, "p": x})
            last = k
        return out


def _ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood ratio of a feature in a of n1 toxic and b of n0 clean documents; 0 unless the odds are on the toxic side."""
    if not a or not n1 or not n0 or (a + 0.5) / n1 < ODDS * (b + 0.5) / n0:
        return 0.0
    share = (a + b) / (n1 + n0)
    return 2 * (a * math.log(a / (n1 * share)) + (b * math.log(b / (n0 * share)) if b else 0.0))


def tied_features(toxic: list[list[bytes]], clean: list[list[bytes]]) -> set[str]:
    """Features whose document counts tie them to toxic documents, overall and in each half of the sample."""

    def counted(docs, wanted=None):
        seen = ({f for t in set(doc) for f in features(t)} for doc in docs)
        return Counter(f for doc in seen for f in (doc if wanted is None else doc & wanted))

    sides = [counted(toxic[k::2]) for k in (0, 1)]
    wanted = {f for f, a in sides[0].items() if a > 1 and sides[1].get(f, 0) > 1}
    # Of clean documents only what could be tied is counted: the driver holds no table of all their features.
    halves = [[{f: sides[k][f] for f in wanted}, counted(clean[k::2], wanted)] for k in (0, 1)]
    n = [(len(toxic[k::2]), len(clean[k::2])) for k in (0, 1)]
    out = set()
    for f in wanted:
        (a, b), (c, d) = ((t[f], o.get(f, 0)) for t, o in halves)
        if min(_ratio(a, b, *n[0]), _ratio(c, d, *n[1])) >= TIED / 3 and _ratio(a + c, b + d, len(toxic), len(clean)) >= TIED:
            out.add(f)
    return out


def _fit_chains(chains: list[list[bytes]], tags: list[list[int]], known: set[str], steps: int = 150, rate: float = 0.3, ridge: float = 1e-5):
    """Weights, bias, transitions and start by gradient ascent (Adam) on the mean log-likelihood of the chains."""
    names = sorted(known)
    number = {f: i for i, f in enumerate(names)}
    size, longest = len(chains), max(map(len, chains))
    mask = np.zeros((size, longest), bool)
    gold = np.zeros((size, longest), np.int64)
    row, col = [], []
    for r, (chain, tag) in enumerate(zip(chains, tags)):
        mask[r, : len(chain)] = True
        gold[r, : len(chain)] = tag
        for t, token in enumerate(chain):
            for f in features(token):
                if f in number:
                    row.append(r * longest + t)
                    col.append(number[f])
    row, col, k = np.array(row, np.int64), np.array(col, np.int64), len(names)
    x = np.zeros(k + 7)  # weights, bias, transitions, start
    x[k] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for it in range(1, steps + 1):
        trans, start = x[k + 1 : k + 5].reshape(2, 2), x[k + 5 :]
        e = (x[k] + np.bincount(row, weights=x[col], minlength=size * longest)).reshape(size, longest)
        a = np.zeros((longest, size, 2))
        z = np.zeros((longest, size, 1))
        ex = np.exp(np.stack([np.zeros_like(e), np.clip(e, -30, 30)], axis=2))
        step = np.exp(trans)
        now = np.exp(start)[None] * ex[:, 0]
        for t in range(longest):
            if t:
                now = np.where(mask[:, t, None], (now @ step) * ex[:, t], now)
            z[t] = now.sum(axis=1, keepdims=True)
            now = now / z[t]
            a[t] = now
        b = np.ones((size, 2))
        node = np.zeros((size, longest, 2))
        pair = np.zeros((2, 2))
        for t in range(longest - 1, -1, -1):
            p = a[t] * b
            node[:, t] = p / p.sum(axis=1, keepdims=True)
            if t:
                on = mask[:, t, None]
                right = ex[:, t] * b
                joint = a[t - 1][:, :, None] * step[None] * right[:, None, :]
                pair += (joint / joint.sum(axis=(1, 2), keepdims=True) * on[:, :, None]).sum(axis=0)
                b = np.where(on, right @ step.T, b)
                b = b / b.max(axis=1, keepdims=True)
        wrong = np.where(mask, gold - node[:, :, 1], 0.0)
        g = np.zeros_like(x)
        g[:k] = np.bincount(col, weights=wrong.ravel()[row], minlength=k)[:k]
        g[k] = wrong.sum()
        both = mask[:, 1:]
        seen = np.bincount((gold[:, :-1] * 2 + gold[:, 1:])[both], minlength=4).reshape(2, 2)
        g[k + 1 : k + 5] = (seen - pair).ravel()
        g[k + 5 :] = np.bincount(gold[:, 0], minlength=2) - node[:, 0].sum(axis=0)
        g = g / size - ridge * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return {f: float(x[i]) for f, i in number.items()}, x[k], x[k + 1 : k + 5].reshape(2, 2).copy(), x[k + 5 :].copy()


def distinct(texts: list[bytes], seen: list[set[int]]) -> list[bytes]:
    """Texts that share no minhash of their word shingles with an earlier one: copies would tie every word they hold."""
    out = []
    for text in texts:
        sketch = minhashes(shingles(text, 5))[: len(seen)].tolist()
        if not any(h in s for h, s in zip(sketch, seen)):
            out.append(text)
            for h, s in zip(sketch, seen):
                s.add(h)
    return out


def fit(toxic: list[bytes], clean: list[bytes], rate: float, per_class: int = PER_CLASS, windows: int = WINDOWS) -> Field:
    """A field from the texts of toxic and clean documents; ``rate``: share of toxic ones among all labelled."""
    toxic, clean = ([x for x in side if x.split()] for side in (toxic, clean))
    seen: list[set[int]] = [set() for _ in range(COPY_HASHES)]
    toxic, clean = distinct(toxic, seen)[:per_class], distinct(clean, seen)[: per_class * CLEAN]
    if not toxic or not clean:
        logit = math.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
        return Field({}, -20.0, np.zeros((2, 2)), np.zeros(2), (0.0, logit))
    one: dict[bytes, bytes] = {}  # a token is held once
    bad, good = ([[one.setdefault(t, t) for t in x.split()] for x in side] for side in (toxic, clean))
    known = tied_features(bad, good)
    marks = {t: any(f in known for f in features(t)) for doc in bad for t in set(doc)}
    chains, tags, rng = [], [], np.random.default_rng(3)
    for side, hot in ((bad, True), (good, False)):
        pieces = [p for doc in side for at in range(0, len(doc), WINDOW) if (p := doc[at : at + WINDOW]) and (not hot or any(marks[t] for t in p))]
        for k in rng.permutation(len(pieces))[:windows]:
            chains.append(pieces[k])
            tags.append([int(hot and marks[t]) for t in pieces[k]])
    field = Field(*(_fit_chains(chains, tags, known) if chains else ({}, -20.0, np.zeros((2, 2)), np.zeros(2))), (1.0, 0.0))
    found = np.array([field.evidence(d)[0] for d in bad + good])
    label = np.concatenate([np.ones(len(bad)), np.zeros(len(good))])
    weight = np.where(label > 0, rate / len(bad), (1 - rate) / len(good))
    x = np.stack([np.log(found + 1e-9), np.ones(len(found))], axis=1)
    w = np.zeros(2)
    for _ in range(60):  # Newton's method for the curve, with a slight pull to zero
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (label - p)) - 1e-4 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    field.curve = (float(w[0]), float(w[1]))
    return field


def remainder(modulus: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, folds: int = 5, windows: int = WINDOWS) -> Field:
    """Fit on labelled rows outside the held-out fold."""
    known = labels.where(remainder(folds) != 0).where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    total = {int(r[0] > 0): int(r[1]) for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("t")).agg(F.count("*")).collect()}
    rate = total.get(1, 0) / max(1, sum(total.values()))
    wanted = {}
    for label in (0, 1):
        # Twice the number, as some have long texts or no text at all.
        for r in known.where((F.col("toxic") > 0).cast("int") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class * (1 if label else CLEAN)).collect():
            wanted[r.doc_id] = label
    if not wanted:
        return fit([], [], rate)
    ids = F.broadcast(spark.createDataFrame([(i, y) for i, y in wanted.items()], "doc_id long, label int"))  # at most 2 * (1 + CLEAN) * per_class rows
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").where((F.length("text") > 0) & (F.length("text") <= max_chars)).select("doc_id", "label", "text")
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.text))
    side = [[r.text.encode() for r in rows if r.label == y] for y in (0, 1)]
    field = fit(side[1], side[0], rate, per_class, windows)
    shared._give_back()  # the driver needs the sample no more
    return field


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans (start, end, p) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(field)  # features of a bounded sample

    def run(batches):
        f = model.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        f.forget()
        for batch in batches:
            scores, spans = [], []
            for text in shared.utf8_rows(batch.column(1)):
                text = bytes(text)
                found, at, p = f.evidence(text.split())
                scores.append(f.score(found))
                spans.append(f.spans(text, at, p) if len(at) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])
        f.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shared.in_arrow, run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, field).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
