"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths (in tokens) of the corpus's frequent pre-tokens, broadcast to all workers
and of fixed size. Tier two is a bounded cache in each Python worker, filled by encoding what is in neither. Pre-tokens
never leave the task they are found in; only each task's summary of frequent words (at most SUMMARY rows) does.

Defined results: a null text is empty (0 bytes, 0 tokens); special strings in a text count as the library counts them,
one token each; every row gives one row, repeated ones too; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.bpe import byte_letters
from quaylight.llm.common import bytes_of, map_batches, worker_store

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of the broadcast table; words a task names; words a task counts at once; entries of a worker's cache.
FREQUENT = 16384
SUMMARY = 4096
COUNTED = 400_000
CACHED = 500_000
LIMIT = 1024


class Encoder:
    """Pre-token lengths of one vocabulary; misses go to the library in batches."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        specials = [t["content"] for t in json.loads(self.library.to_str())["added_tokens"] if t["special"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.specials = set(specials)
        self.words = regex.compile(PATTERN)
        self.fast = by_ranks(json.loads(self.library.to_str()))
        self.know([], np.zeros(0, np.int32))

    def know(self, pieces: list[str], sizes: np.ndarray) -> None:
        """Starts over with tier one: pieces and their lengths."""
        self.frequent, self.base = pieces, sizes
        self.forget()

    def forget(self) -> None:
        """Drops tier two."""
        self.places = _Places((p, k) for k, p in enumerate(self.frequent))
        self.sizes = self.base

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.specials):
            return self.words.findall(text)
        parts = self.split.split(text)
        return [p for i, part in enumerate(parts) if part for p in ([part] if i % 2 else self.words.findall(part))]

    def lengths(self, pieces: list[str]) -> list[int]:
        if self.fast:
            encode = self.fast.encode_ordinary
            return [1 if p in self.specials else len(encode(p)) for p in pieces]
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [len(e) for k in range(0, len(pieces), 8192) for e in encode(pieces[k : k + 8192], add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.places) - len(self.frequent) > CACHED:
            self.forget()
        place = self.places.__getitem__
        placed = [np.fromiter(map(place, p), np.int32, len(p)) for p in map(self.pieces, texts)]
        if missed := self.places.fresh:
            self.sizes = np.concatenate([self.sizes, np.asarray(self.lengths(missed), np.int32)])
            self.places.fresh = []
        return [int(self.sizes[at].sum()) for at in placed]


def by_ranks(spec: dict):
    """The vocabulary in the form that encodes single pre-tokens fastest, if its merges are numbered in order."""
    import tiktoken

    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    value = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(value[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Places(dict):
    """Pre-tokens by number; a new one gets the next number and waits in fresh for its length."""

    def __init__(self, known) -> None:
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


def encoder(path: str) -> Encoder:
    store = worker_store("token-counts")
    if path not in store:
        store[path] = Encoder(path)
    return store[path]


def frequent_words(docs: DataFrame, n: int = FREQUENT) -> list[str]:
    """The n most frequent white-space words of all texts, by lossy counting in each task and a sum of the summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            raw = data.tobytes()
            for a in range(0, len(raw), 1 << 22):  # a word cut here only adds two odd words
                seen.update(raw[a : a + (1 << 22)].split())
                while len(seen) > COUNTED:
                    least = np.partition(np.fromiter(seen.values(), np.int64, len(seen)), len(seen) // 2)[len(seen) // 2]
                    seen = Counter({w: c for w, c in seen.items() if c > least})
        top = [(w.decode(errors="ignore"), c) for w, c in seen.most_common(SUMMARY) if c > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["word", "n"])

    spread = docs.select("text").mapInArrow(run, "word string, n long")
    rows = spread.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()
    return [r["word"] for r in rows]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    own = encoder(path)
    words = [f" {w}" for w in frequent_words(docs)]
    pieces = sorted({p for w in words for p in own.pieces(w)})
    lengths = np.asarray(own.lengths(pieces), np.int32)
    sent = docs.sparkSession.sparkContext.broadcast(("\n".join(pieces).encode(), lengths))
    name = uuid.uuid4().hex

    def state() -> Encoder:
        mine = encoder(path)
        if worker_store("token-counts").get("sent") != name:
            raw, sizes = sent.value
            mine.know(raw.decode().split("\n") if len(sizes) else [], sizes)
            worker_store("token-counts")["sent"] = name
        return mine

    def step(batch: pa.RecordBatch, mine: Encoder) -> pa.RecordBatch:
        _, offsets = bytes_of(batch.column(1))
        n = np.asarray(mine.counts([t or "" for t in batch.column(1).to_pylist()]), np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", step, state)
