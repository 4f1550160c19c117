"""BPE encoding and decoding by a priority queue of merge ranks over a doubly linked symbol list.

The tokenizer file gives vocabulary, merges, normalisation and word pattern; nothing is trained.  A text
is cut at ASCII white space, which no token crosses, so that each worker encodes a distinct chunk once
and looks it up afterwards.  Decoding concatenates vocabulary strings.

Null texts count as empty; an empty text has no tokens and decodes to the empty text.  Strings of special
tokens inside a text become those tokens, as the library does by default.
"""

from __future__ import annotations

import json
import os
import string
import struct
import unicodedata
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Chunks that a worker remembers, so memory is bounded: when half of them are new, those not met meanwhile go.
REMEMBERED = 240_000
#: Bytes of a batch handed back to Spark; both sides hold it a few times over.
BATCH_BYTES = 4 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: The end of a word pattern whose other kinds of words have no letter at their start.
#: So a word of letters with signs behind it is two words.
LETTERS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: ASCII that is neither letter, number nor white space, nor control.
SIGNS = string.punctuation


class Remembered(dict):
    """Ids by bytes, made where they are missing; long keys are not kept."""

    def __init__(self, make: Callable[[bytes], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: bytes) -> bytes:
        ids = self.before.pop(key, None)
        if ids is None:
            ids = self.make(key)
        if len(key) < 64:
            if len(self) >= REMEMBERED // 2:
                self.before = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Bpe:
    """Encoder and decoder for one tokenizer file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError("not a tokenizer of the kind that this operator reads")
        self.strings = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for string, i in vocab.items():
            self.strings[i] = string
        for token in spec["added_tokens"]:
            self.strings[token["id"]] = token["content"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        ranks: list[dict[int, int]] = [{}] * len(self.strings)
        #: The id that a rank makes; by the first id of a pair, what gives the rank of a second one.
        self.made: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            ranks[vocab[a]] = ranks[vocab[a]] or {}
            ranks[vocab[a]][vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.rank = [r.get for r in ranks]
        words = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(words.replace(r"[^\s", r"[^\p{White_Space}"))
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        #: How all added tokens begin.
        self.sign = os.path.commonprefix([*self.added]).encode()
        #: Whether letters are one word, and signs behind them another; and no added token is all ASCII letters.
        self.whole = words.endswith(LETTERS) and not any(t.encode().isalpha() for t in self.added)
        #: Chunks, words of letters and signs behind them are remembered together, other words apart.
        self.final, self.known = Remembered(self.chunk), Remembered(self.word)
        self.utf8 = [s.encode() for s in self.strings]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: its symbols, merged by rank and then from the left."""
        ids = [*map(self.inner.__getitem__, word)]
        ids[-1] = self.last[word[-1]]
        n, rank, made = len(ids), self.rank, self.made
        ranked = [rank[a](b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that begins at a symbol; -1: none
        ranked.append(-1)
        bits = n.bit_length()  # of a symbol's place, below its rank in the queue
        queue = [r << bits | i for i, r in enumerate(ranked) if r >= 0]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heapify(queue)
        while queue:
            r = (key := heappop(queue)) >> bits
            i = key - (r << bits)
            if ranked[i] != r:
                continue  # stale: one of the two symbols has been merged meanwhile
            j = after[i]
            ids[i] = new = made[r]
            ids[j] = ranked[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                ranked[i] = r = rank[new](ids[k], -1)
                if r >= 0:
                    heappush(queue, r << bits | i)
            else:
                ranked[i] = -1
            if (h := before[i]) >= 0:
                ranked[h] = r = rank[ids[h]](new, -1)
                if r >= 0:
                    heappush(queue, r << bits | h)
        return [x for x in ids if x >= 0]

    def word(self, word: bytes) -> bytes:
        """Packed ids of one word."""
        ids = self.merged(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join([self.known[word.encode()] for word in self.words.findall(text.lower())])

    def chunk(self, chunk: bytes) -> bytes:
        """Packed ids of text without ASCII white space."""
        if self.whole and (head := chunk.rstrip(SIGNS.encode())).isalpha():
            if chunk.islower() and head == chunk:
                return self.word(chunk)
            if head == chunk or self.sign not in chunk:
                return self.final[head.lower()] + (self.final[chunk[len(head) :]] if head != chunk else b"")
        text = chunk.decode()
        if self.whole and self.sign not in chunk and (head := text.rstrip(SIGNS)).isalpha():
            low = unicodedata.normalize("NFC", head).replace("Σ", "σ").lower()
            if low == text:
                return self.word(chunk)
            if low.isalpha() and unicodedata.normalize("NFC", low).lower() == low:  # so as a chunk it is this word
                return self.final[low.encode()] + (self.final[text[len(head) :].encode()] if head != text else b"")
        if self.at_added is None or self.sign not in chunk or self.at_added.search(text) is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.final.__getitem__, text.split()))

    def decode(self, packed: bytes) -> bytes:
        """The vocabulary strings of packed ids, joined as the file's decoder says (none: by spaces), in UTF-8."""
        return b" ".join(map(self.utf8.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False, keep: tuple[str, ...] = (), chars: bool = False) -> DataFrame:
    """doc_id (and the columns of ``keep``), n_tokens, ids (binary: packed little-endian unsigned 32-bit), and if asked ``decoded`` and ``decoded_chars``.

    ``tokenizer`` is a path that every worker has.  ``decoded_chars`` is the length of the decoded text, which then need not leave the worker.
    """
    kept = [f.name for f in docs.select(*keep).schema]
    schema = ", ".join(["doc_id long", *(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in kept), "n_tokens long", "ids binary"] + ["decoded string"] * decoded + ["decoded_chars long"] * chars)

    def run(batches):
        bpe = loaded(tokenizer)
        for batch in batches:
            at, size, out = 0, 0, []

            def taken(stop):
                packed = [x[0] for x in out]
                columns = [batch.column(c).slice(at, stop - at) for c in range(1 + len(kept))]
                columns += [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([x[1] for x in out], pa.binary()).cast(pa.string()))
                if chars:
                    columns.append(pa.array([x[2] for x in out], pa.int64()))
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", *kept, "n_tokens", "ids"] + ["decoded"] * decoded + ["decoded_chars"] * chars)

            for i, text in enumerate(shared.utf8_rows(batch.column(batch.num_columns - 1))):
                ids = bpe.encode(bytes(text))
                back = bpe.decode(ids) if decoded or chars else b""
                out.append((ids, back if decoded else b"", len(back.decode()) if chars else 0))
                size += len(ids) + len(out[-1][1])
                if size >= BATCH_BYTES:
                    yield taken(i + 1)
                    at, size, out = i + 1, 0, []
            yield taken(batch.num_rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *kept, F.col("text").cast("string").alias("text")).transform(shared.in_arrow, run, schema)


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and decoded text of rows that hold packed ids; null ids decode to the empty text."""

    def run(batches):
        bpe = loaded(tokenizer)
        for batch in batches:
            text = [bpe.decode(bytes(x)) for x in shared.utf8_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").transform(shared.in_arrow, run, "doc_id long, decoded string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, default_tokenizer(), decoded=True).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
