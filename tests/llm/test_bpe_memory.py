"""What a BPE worker remembers: frequent chunks stay while others come and go, and memory stays bounded."""

import corpus_pipeline
from siftmill.llm import bpe


def test_frequent_words_are_merged_once(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    coder = bpe.Bpe(bpe.default_tokenizer())
    made = []
    merged = coder.merged
    coder.merged = lambda word: made.append(word) or merged(word)
    rare = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    text = " ".join(f"often {w} seldom," for w in rare).encode()
    got = coder.encode(text)
    assert made.count(b"often") == made.count(b"seldom") == 1
    assert all(len(x) + len(x.before) <= 20 for x in (coder.final, coder.known))
    assert got == b"".join(bpe.Bpe(bpe.default_tokenizer()).encode(c) for c in text.split())
    assert coder.decode(got).count(b"often") == 100


def test_letters_and_added_tokens():
    coder = bpe.Bpe(bpe.default_tokenizer())
    whole = bpe.Bpe(bpe.default_tokenizer())
    whole.whole = False
    for text in ("Word", "don't <|endoftext|>x a<|b", "ÉΣx STRASSE ﬁ", "x1y2--z", ""):
        assert coder.encode(text.encode()) == whole.encode(text.encode())
    assert coder.encode("ab<|endoftext|>cd".encode()) == coder.encode(b"ab <|endoftext|> cd")


def test_a_word_is_remembered_once():
    coder = bpe.Bpe(bpe.default_tokenizer())
    text = "some words, all of letters... and été, here twice: some words, all of letters... and été, here twice:"
    got = coder.encode(text.encode())
    assert set(map(bytes.decode, coder.final)) == {*text.split(), *(w.rstrip(",.:") for w in text.split()), ",", "...", ":"}
    assert set(coder.known) == {b",", b"...", b":"}
    assert got == b"".join(coder.word(w) for part in text.split() for head in [part.rstrip(",.:")] for w in (head.encode(), part[len(head) :].encode()) if w)


def test_the_pipeline_takes_lengths_not_decoded_texts(docs, monkeypatch):
    made = []
    real = bpe.shared.in_arrow
    monkeypatch.setattr(bpe.shared, "in_arrow", lambda df, run, schema: made.append(schema) or real(df, run, schema))
    texts = [None, "", "É don't 🙂, x", "two words " * 500]
    rows = corpus_pipeline.tokenize(docs(texts).sparkSession, docs(texts), "").collect()
    coder = bpe.Bpe(bpe.default_tokenizer())
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_chars) for r in rows} == {k: (len(i) // 4, i, len(coder.decode(i).decode())) for k, i in enumerate(coder.encode((t or "").encode()) for t in texts)}
    assert len(made) == 1 and "string" not in made[0].split("source")[1].split(",", 1)[1]


def test_batches_of_long_texts_are_small(docs, monkeypatch):
    sizes = []

    def seen(df, run, schema):
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": [*range(40)], "text": ["some words of a text " * 10_000] * 40})
        sizes.extend(b.nbytes for b in run([batch]))
        return df

    monkeypatch.setattr(bpe.shared, "in_arrow", seen)
    bpe.encode(docs(["a"]), bpe.default_tokenizer(), decoded=True)
    assert sum(sizes) > 16 << 20 and max(sizes) < 6 << 20


def test_each_stage_begins_with_free_heaps(docs):
    rows = docs(["some words", "other words"])
    spark = rows.sparkSession
    beans = lambda: spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if not any(x in b.getName() for x in ("Young", "Copy", "Scavenge")))
    for name in ("mixing", "bpe"):
        before = full()
        dict(corpus_pipeline.STAGES)[name](spark, rows, "")
        assert full() > before
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
