"""Language model, toxicity, mixing, extraction and the pipeline."""

import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from siftmill.llm import html_extract, mixing, ngram_lm, toxicity

from .conftest import ODD


def test_language_model_is_kneser_ney(spark, docs):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(vocabulary, p=np.arange(40, 0, -1) / 820, size=rng.integers(1, 40))) for _ in range(120)] + ODD
    train = [(i, t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    model = ngram_lm.train(spark, docs([(i, t, "s") for i, t in train]))
    got = {r.doc_id: r for r in ngram_lm.score(docs([*texts, "never seen words"]), model).collect()}
    split = lambda t: [*(t or "").encode().lower().split(), None]
    pairs = Counter(p for _, t in train for p in zip([0, *split(t)[:-1]], split(t)))
    count, before, total, kinds = Counter(), Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, w), c in pairs.items():
        count[w] += c
        before[w] += 1
        total[v] += c
        kinds[v][min(c, 3) - 1] += 1
    coc = lambda cs: [sum(c == k for c in cs) for k in (1, 2, 3, 4)]
    high, low = ngram_lm.discounts(coc(pairs.values())), ngram_lm.discounts(coc(before.values()))
    spare = sum(low[min(c, 3) - 1] for c in before.values()) / len(pairs)

    def p(v, w):
        lower = (max(0.0, before[w] - low[min(before[w], 3) - 1]) / len(pairs) if w in before else 0.0) + spare / (len(count) + 1)
        if v not in total:
            return lower
        c = pairs.get((v, w), 0)
        return ((c - high[min(c, 3) - 1]) / total[v] if c else 0.0) + sum(d * k for d, k in zip(high, kinds[v])) / total[v] * lower

    for v in (0, b"w0", b"w39", b"unseen"):
        assert abs(sum(p(v, w) for w in count) + p(v, b"not a word") - 1) < 1e-9
    for i, t in enumerate([*texts, "never seen words"]):
        words = split(t)
        assert abs(got[i].score - sum(math.log10(p(v, w)) for v, w in zip([0, *words[:-1]], words))) < 1e-6
        assert abs(got[i].base_score - sum(math.log10((count[w] + 1) / (sum(count.values()) + len(count) + 1)) for w in words)) < 1e-6
        assert (got[i].n_tokens, got[i].n_known) == (len(words), sum(w in count for w in words))


def test_language_model_without_rows(spark, docs):
    model = ngram_lm.train(spark, docs([]))
    assert model.tokens == 0
    assert [(r.score, r.base_score) for r in ngram_lm.score(docs(["a b"]), model).collect()] == [(0.0, 0.0)]
    assert ngram_lm.score(docs([]), model).count() == 0


def brute_evidence(field, tokens):
    """Forward pass one token at a time."""
    if not tokens:
        return 0.0, []
    e = [field.emission(t) for t in tokens]
    a = np.exp(field.start + [0, e[0]])
    alphas, log = [a / a.sum()], math.log(a.sum())
    for x in e[1:]:
        a = alphas[-1] @ field.step(x)
        log += math.log(a.sum())
        alphas.append(a / a.sum())
    beta, p = np.ones(2), [0.0] * len(e)
    for k in range(len(e) - 1, -1, -1):
        both = alphas[k] * beta
        p[k] = both[1] / both.sum()
        beta = field.step(e[k]) @ beta
        beta = beta / beta.sum()
    return log - (field.start[0] + (len(e) - 1) * field.trans[0, 0]), p


def test_toxicity(spark, docs):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for k in range(600):
        words = [f"word{x}" for x in rng.integers(0, 300, rng.integers(5, 80))]
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["nasty,", "Vilest", "foulish" + "abcdef"[rng.integers(0, 6)]])))
        texts.append(" ".join(words))
        labels.append((k, int(bad)))
    d = docs([*texts, *ODD, "é word1 nasty, Vilest word2"])
    field = toxicity.learn(spark, d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, field).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k].score >= 0.5) == bool(y) for k, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[600].score < 0.5
    last = got[600 + len(ODD)]
    assert [("é word1 nasty, Vilest word2"[s.start : s.end]) for s in last.spans] == ["nasty, Vilest"]
    for t in [texts[0], texts[1], "", "one", "nasty", "word1 " * 500 + "nasty", *[x or "" for x in ODD]]:
        tokens = t.encode().split()
        found, at, p = field.evidence(tokens)
        want, q = brute_evidence(field, tokens)
        assert abs(found - max(0.0, want)) < 1e-6 * max(1.0, want)
        assert np.allclose(p, [q[k] for k in at], atol=1e-6)
    none = toxicity.learn(spark, d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score(d, none).collect())


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert np.allclose(mixing.targets([100, 1, 100], [1, 2, 3]), [(201 - 3) / 4, 3, (201 - 3) * 3 / 4])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_splitting_tree():
    quotas = np.array([100, 7, 0, 33])
    out = mixing.splitting_tree(quotas, 8, np.random.default_rng(0))
    assert (out.sum(axis=1) == quotas).all() and (out >= 0).all()
    assert out.sum(axis=0).max() - out.sum(axis=0).min() <= 3


def test_mixing(spark, docs):
    rng = np.random.default_rng(6)
    rows = [(k, "w " * int(rng.integers(0, 60)), [None, "a", "b", "hot", "hot", "hot", ""][k % 7]) for k in range(1400)]
    d = mixing.sized(docs(rows).selectExpr("*", "'x' as block", "1 as picked_", "'c' as copy"))
    runs = [sorted((r.doc_id, r.size, r.target, r.source_size, tuple(map(tuple, r.placements))) for r in mixing.mix(spark, x).collect()) for x in (d, d.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 1400
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for i, size, t, _, placements in runs[0]:
        taken[source[i]] += size * len(placements)
        target[source[i]] = t
        assert len(placements) <= 3 and len({p[0] for p in placements}) == len(placements)
    assert abs(sum(target.values()) - sum(r[1] for r in runs[0])) < 1e-6
    assert all(abs(taken[s] - t) <= 30 for s, t in target.items())
    assert mixing.copies(mixing.mix(spark, d)).count() == sum(len(r[4]) for r in runs[0])
    assert mixing.mix(spark, mixing.sized(docs([]))).count() == 0
    odd = mixing.mix(spark, mixing.sized(docs(ODD))).collect()
    assert len(odd) == len(ODD)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>
<div>{notice}</div><article><header><h1>{title}</h1></header><p>First <b>bold</b>text &amp; more&nbsp;here<p>Second<br>line<ul><li>one<li>two</ul><aside>see also</aside><form>Mail <input></form>
<p>Share this story with your friends</p></article><section class="comments"><p>Great post</p></section><div id="cookie-banner">We use cookies</div><footer>(c)</footer>"""


def test_extraction(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(notice="Welcome back to our site", title=f"Title {k}")) for k in range(12)] + [(50, None, None), (51, "x", ""), (52, "http://b.example/", "plain <b>text</b> &lt;3"), (53, "http://c.example/", "<div><p>only</p></div>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k].startswith(f"Title {k} First boldtext & more here Second line one two")
        assert not re.search("Site|Home|Welcome|see also|Mail|Great|cookies|\\(c\\)", got[k])
    assert (got[50], got[51], got[52], got[53]) == ("", "", "plain text <3", "only")
    assert html_extract.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_tells_template_from_content():
    pages = [f"<body><div><div>Subscribe to our letter today</div><div><p>Story {k} tells {k * 7} things.</p><p>It ends with {k}.</p></div></div></body>" for k in range(9)]
    wrapper = None
    for p in pages:
        tree = html_extract.tree_of(html_extract.parse(p))
        wrapper = tree if wrapper is None else html_extract.merged(wrapper, tree)
    assert html_extract.main_text(pages[3], wrapper) == "Story 3 tells 21 things. It ends with 3."
    copy = "<body><div><p>The very same article stands on most pages of this host.</p></div></body>"
    tree = html_extract.tree_of(html_extract.parse(copy))
    wrapper = tree
    for _ in range(5):
        wrapper = html_extract.merged(wrapper, tree)
    assert html_extract.main_text(copy, wrapper) == "The very same article stands on most pages of this host."


def test_extraction_of_test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(spark, pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]*>", " ", article))
        assert got[r.page_id] == " ".join(html.unescape(want).split())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as size", "'x' as gone", "2 as target")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{corpus_pipeline.shared.work_dir(spark, f'test-{name}')}")
        docs = spark.read.parquet(path)
        assert docs.count() > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert {"doc_id", "n_tokens"} <= set(docs.columns)


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """Each stage on all documents: which rows stay, what the mix takes, and which tokens come out."""
    from tokenizers import Tokenizer

    from siftmill.llm import bpe

    from .test_near_dedup import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    more = sf_dir.replace("sf0.001", "sf0.01")  # eleven toxic labels of the small tables teach nothing
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{more}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["toxicity"](spark, spark.read.parquet(f"{more}/documents.parquet"), more).collect()}
    clean, toxic = ([i for i, y in label.items() if y == k and zlib.crc32(str(i).encode()) % 5 == 0] for k in (0, 1))
    assert len(toxic) >= 5 and len(kept & set(clean)) >= 0.97 * len(clean) and 2 * len(kept & set(toxic)) < len(toxic)  # of six held-out ones

    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for i, t in text.items():
        best[bare(t)] = min(best.get(bare(t), (0, i)), (-len(t), i)) if bare(t) in best else (-len(t), i)
    assert {r.doc_id for r in stages["exact_dedup"](spark, docs, sf_dir).collect()} == {i for _, i in best.values()}

    want = brute(list(text.items()), 80)
    assert {r.doc_id for r in stages["near_dedup"](spark, docs, sf_dir).collect()} == {i for i, (_, c) in want.items() if c == i}

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    mixed = Counter(r.doc_id for r in stages["mixing"](spark, docs, sf_dir).collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted(set(source.values()))
    sizes = [sum(words(t) for i, t in text.items() if source[i] == s) for s in names]
    for s, goal in zip(names, mixing.targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(names))])):
        longest = max(words(t) for i, t in text.items() if source[i] == s)
        assert abs(sum(n * words(text[i]) for i, n in mixed.items() if source[i] == s) - goal) <= longest
    assert max(mixed.values()) <= 3

    library = Tokenizer.from_file(bpe.default_tokenizer())
    for r in stages["bpe"](spark, docs, sf_dir).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded_chars == len(library.decode(ids, skip_special_tokens=False))


def _texts_of_host(spark, bodies):
    rows = [(k, f"http://h.example/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    got = html_extract.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_constant_siblings_at_any_place(spark):
    div = lambda *x: "".join(f"<div>{t}</div>" for t in x)
    story = [f"story {k} has short words" for k in range(6)]
    assert _texts_of_host(spark, [div("our first line of all", "a longer note on every page", s, "buy this thing today", "the last line of all") for s in story]) == story


def test_constant_end_of_long_pages(spark):
    long = ["".join(f"<h2>head {k} {i}</h2><p>text {k} {i}</p>" for i in range(50)) for k in range(6)]
    got = _texts_of_host(spark, [b + "<ul><li>goes on every page</li></ul>" for b in long])
    assert all("goes on every page" not in t and f"text {k} 49" in t for k, t in enumerate(got))


def test_wrapper_alone_finds_the_text(spark):
    """No article, main or class hint: the host's pages tell template from content, also where most are copies."""
    page = "<div><p>Daily Harbour</p><p>All about ships</p></div><div><p>{0}</p><p>and more of {0}</p></div><div><p>Write to us at the harbour</p><p>made with care</p></div>"
    story = [f"ship {k} came in" for k in range(7)]
    assert _texts_of_host(spark, [page.format(s) for s in story]) == [f"{s} and more of {s}" for s in story]
    copies = [page.format(s) for s in ["the same long story of one ship for everyone"] * 9 + story]
    assert _texts_of_host(spark, copies)[:10] == ["the same long story of one ship for everyone and more of the same long story of one ship for everyone"] * 9 + ["ship 0 came in and more of ship 0 came in"]
    two = _texts_of_host(spark, [page.format(s) for s in story[:2]])
    assert all(t.startswith("Daily Harbour") for t in two)  # no wrapper from two pages


def test_parts_of_an_article_stay(spark):
    body = "<article><p>Intro {0}</p><ul><li><a href=a>one {0}</a></li><li><a href=b>two {0}</a></li><li><a href=c>three</a></li></ul><div class=notice-period>Period {0}</div><section id=form>Form of {0}</section><p class=tags>Tags {0}</p><div class=share-bar>Share {0}</div></article>"
    got = _texts_of_host(spark, [body.format(k) for k in range(5)])
    assert got == [f"Intro {k} one {k} two {k} three Period {k} Form of {k} Tags {k}" for k in range(5)]


def test_long_page(spark):
    words = " ".join(f"word{k}" for k in range(40_000))
    assert _texts_of_host(spark, [f"<nav>menu</nav><article><p>{words}</p></article>"]) == [words]
    assert _texts_of_host(spark, ["<div>" * 300 + "deep" + "</div>" * 300]) == ["deep"]


def test_mix_is_written_in_shard_order(spark, docs):
    d = docs([f"text {k} " * (1 + k % 5) for k in range(900)])
    rows = mixing.sized(d).drop("text")
    place = defaultdict(list)
    for r in mixing.copies(mixing.mix(spark, rows)).collect():
        place[r.doc_id].append((r.shard, r.order))
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, d, "").collect()]
    assert Counter(got) == Counter({k: len(v) for k, v in place.items()})
    assert got == [k for _, k in sorted((p, k) for k, v in place.items() for p in v)]


def test_mixing_with_clashing_columns_and_missing_ids(spark, docs):
    rows = [(None if k % 9 == 0 else 2**62 + k, "w " * (1 + k % 11), "ab"[k % 2]) for k in range(300)]
    d = mixing.sized(docs(rows).selectExpr("*", "1 as picked", "2 as picked_id", "3 as document", "4 as target", "5 as mix_key", "6 as block", "7 as placed", "8 as gap", "9 as none"))
    out = mixing.mix(spark, d)
    assert out.columns == [c for c in d.columns if c != "target"] + ["source_size", "target", "placements"]
    got = out.collect()
    assert len(got) == 300 and {r.picked for r in got} == {1}
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r["size"] * len(r.placements) for r in own) - own[0].target) <= 11 * 34  # rows without an id are drawn alike
    assert {p.shard for r in got for p in r.placements} <= set(range(64))


def test_toxicity_with_odd_columns_and_long_text(spark, docs):
    d = docs([(1, "nasty " + "word " * 60_000, "s"), (None, None, "s")]).selectExpr("*", "1 as score", "2 as spans", "3 as label")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 and r.spans == [] for r in toxicity.score(d, toxicity.learn(spark, d, labels)).collect())
    assert toxicity.score(docs([]), toxicity.learn(spark, docs([]), labels)).count() == 0


def test_fitted_field_is_the_best_one():
    """The fit against brute force: at the optimum the model's expected counts are those of the labelled tokens."""
    chains = [[b"a", b"bad", b"c"], [b"bad", b"bad"], [b"c", b"a"], [b"a", b"c", b"bad"]] * 5
    tags = [[0, 1, 0], [1, 1], [0, 0], [0, 0, 1]] * 5
    weights, bias, trans, start = toxicity._fit_chains(chains, tags, {"w=bad"}, steps=600, rate=0.05, ridge=1e-2)
    field = toxicity.Field(weights, bias, trans, start, (1.0, 0.0))

    def likelihood(x):
        f = toxicity.Field({"w=bad": x[0]}, x[1], np.array(x[2:6]).reshape(2, 2), np.array(x[6:]), (1.0, 0.0))
        total = 0.0
        for chain, tag in zip(chains, tags):
            e = [f.emission(t) for t in chain]
            paths = [[(k >> j) & 1 for j in range(len(chain))] for k in range(2 ** len(chain))]
            value = lambda y: f.start[y[0]] + sum(e[j] * y[j] for j in range(len(y))) + sum(f.trans[a, b] for a, b in zip(y, y[1:]))
            total += value(tag) - math.log(sum(math.exp(value(y)) for y in paths))
        return total / len(chains) - 0.5e-2 * sum(v * v for v in x)

    best = [field.weights["w=bad"], field.bias, *trans.ravel(), *start]
    top = likelihood(best)
    for k in range(len(best)):
        for d in (-0.3, 0.3):
            assert likelihood([v + d * (i == k) for i, v in enumerate(best)]) <= top + 1e-4


def test_shards_follow_the_table(spark, docs, sf_dir, monkeypatch):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(ngram_lm, "SHARD_BYTES", 1 << 14)
    assert ngram_lm.shards_of(spark, d) > 10
    model = ngram_lm.train(spark, d)
    odd = d.selectExpr("*", "1 as score", "2 as shard", "3 as payload", "4 as kind").limit(40)
    assert all(r.score < 0 and r.n_known <= r.n_tokens for r in ngram_lm.score(odd, model).collect())
