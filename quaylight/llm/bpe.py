"""BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct pre-tokens of its texts and lays their symbols out in one array. An index maps each
adjacent pair's rank to all positions where the pair occurs; ranks with positions are applied in ascending order, each
to all its positions at once, and the pairs that a merge makes are added to their ranks' lists. A rank that becomes
active again later is applied again, so within a pre-token the lowest rank always goes first. Texts are then written
from the pre-tokens' ids.

Defined results: a null text is an empty one (no ids, empty decoding); special strings in a text become their own ids,
as in the library; decoding joins token strings the way a vocabulary without decoder does, by one space; every row
gives one row, repeated ones too; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.common import cut, offsets_of, worker_store

#: Text bytes that are gathered before their new pre-tokens are merged together; pre-tokens a worker keeps.
GATHER = 24 << 20
KEPT = 500_000
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """A word-end BPE vocabulary: base symbols, merges by rank, and the pair to rank lookup."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.size = max(max(vocab.values()), max(self.specials.values(), default=0)) + 1
        self.none = len(pairs)
        codes = self.left * self.size + self.right
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank_of = codes[order], order.astype(np.int64)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + END] for c in letters], np.int32)
        self.tokens = [b""] * self.size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token.encode()
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        names = sorted(self.specials, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, wanted), self.none - 1)
        return np.where(self.codes[at] == wanted, self.rank_of[at], self.none)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; a special string stands for itself, and the text between them is normalised alone."""
        if self.split is None or not any(s in text for s in self.specials):
            return self.pattern.findall(self.normal(text))
        parts = self.split.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.pattern.findall(self.normal(part)))]

    @staticmethod
    def normal(text: str) -> str:
        """Composed and in small letters, letter by letter: a final sigma is not special."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of distinct words that are no special strings."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        ends = np.cumsum(lengths) - 1
        symbols = self.inner[data]
        symbols[ends] = self.last[data[ends]]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends] = -1
        before[ends[:-1] + 1] = -1
        heads = np.flatnonzero(after >= 0)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        self._add(index, active, heads, self.ranks(symbols[heads], symbols[heads + 1]))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            self._apply(rank, at, symbols, after, before, index, active)
        live = symbols >= 0
        counts = np.add.reduceat(live, ends - lengths + 1, dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        return symbols[live], counts

    def _add(self, index: dict[int, list[np.ndarray]], active: list[int], at: np.ndarray, ranks: np.ndarray) -> None:
        """Position lists go to their ranks; a rank that has none yet becomes active."""
        known = ranks < self.none
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], edges])].tolist(), np.split(at, edges) if len(edges) else [at]):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(active, rank)

    def _apply(self, rank: int, at: np.ndarray, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, index: dict[int, list[np.ndarray]], active: list[int]) -> None:
        left, right = self.left[rank], self.right[rank]
        gone = after[at]
        holds = (symbols[at] == left) & (gone >= 0) & (symbols[gone] == right)  # other merges may have taken a side
        if not holds.all():
            at, gone = at[holds], gone[holds]
        if left == right and len(at) > 1:  # of overlapping pairs, every second one from the left
            fresh = np.concatenate([[True], gone[:-1] != at[1:]])
            place = np.arange(len(at))
            even = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
            at, gone = at[even], gone[even]
        if not len(at):
            return
        symbols[at] = self.made[rank]
        symbols[gone] = -1
        follow = after[gone]
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        heads = np.concatenate([ahead, at[has]])
        self._add(index, active, heads, self.ranks(symbols[heads], symbols[after[heads]]))


class Coder:
    """Merges with the pre-tokens a worker has met: their places, ids and decoded strings."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        self.places = _Places()
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.strings: list[bytes] = []

    def learn(self) -> None:
        """Ids and strings of the pre-tokens that have a place but no ids yet."""
        new = list(self.places)[len(self.strings) :]
        if not new:
            return
        plain = [w for w in new if w not in self.merges.specials]
        ids, counts = self.merges.encode(plain) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if len(plain) < len(new):
            ends = dict(zip(plain, np.cumsum(counts).tolist()))
            size = dict(zip(plain, counts.tolist()))
            parts = [np.array([self.merges.specials[w]], np.int32) if w in self.merges.specials else ids[ends[w] - size[w] : ends[w]] for w in new]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        names = list(map(self.merges.tokens.__getitem__, ids.tolist()))
        k = 0
        for c in counts.tolist():
            self.strings.append(b" ".join(names[k : k + c]))
            k += c

    def code(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """(ids, decoded text) of each text."""
        if len(self.places) > KEPT:
            self.reset()
        find, place = self.merges.pieces, self.places.__getitem__
        placed = [np.fromiter(map(place, p), np.int32, len(p)) for p in map(find, texts)]
        self.learn()
        for at in placed:
            counts = self.counts[at]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            yield self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(total)], b" ".join(map(self.strings.__getitem__, at.tolist()))


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def coder(path: str) -> Coder:
    store = worker_store("bpe")
    if path not in store:
        store[path] = Coder(Merges(path))
    return store[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian, one after another), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(path)
        for batch in batches:
            for part in cut(batch, GATHER):
                rows: list[tuple[bytes, bytes]] = []
                first = held = 0
                sizes = np.diff(offsets_of(part.column(1)))
                for i, (ids, text) in enumerate(mine.code(t or "" for t in part.column(1).to_pylist())):
                    rows.append((ids.astype("<u4").tobytes(), text))
                    held += int(sizes[i]) + 64
                    if held > 4 << 20:
                        yield out(part.column(0).slice(first, len(rows)), rows)
                        first, held, rows = i + 1, 0, []
                if rows:
                    yield out(part.column(0).slice(first), rows)

    def out(ids: pa.Array, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def coded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_decode(docs, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
