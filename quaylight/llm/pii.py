"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The field is trained here, once in a process, from a small labelled table (frames filled from short lists, and prose
without any personal data) by the gradient of its log-likelihood (forward-backward). Texts are decoded by Viterbi over batches of lines in numpy.
It adds names, street addresses and document numbers, which have no fixed form; what overlaps a pattern's span is left out.

Defined results: a null text is an empty one and has no spans; offsets are code points, end exclusive; a sequence is a
whole line, however long, and a text of any length is decoded whole; every row gives one row, repeated ones too; an empty
table gives no rows; only doc_id and text are read, other columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaylight.llm.common import map_batches, worker_store

# The patterns of the base scan. An ip match can only start where its run of digits does.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone", "name", "address", "id")

LABELS = ("O", "B-name", "I-name", "B-address", "I-address", "B-id", "I-id")
#: Up to so many sequences, a step of the decoding takes all pairs of labels in one array.
FEW = 128

# The labelled table: frames with slots (n a name, f a family name, t a title, a an address, c a town, s and p document
# numbers) that are filled from short lists, and lines without personal data. Half of the names are made up, so that
# frames and shapes count and not only known names.
FRAMES = """
My name is {n} and I live in the north.|My name is {n}.|Her name is {n}, she said.|His name is {n} and he works here.|I am {n} from {c}.|This is {n} speaking.
Dear {t} {n}, thank you for the letter.|Dear {t} {f},|Dear {n}, the order has shipped.|Hello {n}, how are you today?|Please contact {t} {n} for help.|Please contact {n} at the office.
Signed by {t} {n} on Monday.|Signed by {n}.|Signed, {n}|Sincerely, {n}|Kind regards, {n}|Best wishes from {n}|The report was sent to {t} {n} last week.|The letter was written by {n}.
We spoke with {t} {n} about it.|We spoke with {n} and {n} there.|Patient name: {n}, seen today.|Patient: {n}|Customer name: {n}|Customer: {n}|Full name: {n}|Name: {n}|Author: {n}|Contact: {n}, {a}, {c}|Contact person: {n}
I saw {n} yesterday in {c}.|We met {n} last week.|They met {n} in {c} on Monday.|She called {n} this morning.|He married {n} in May.|I asked {n} about the house.|We thank {n} for the help.|The boy told {n} a story.
{n} works at the office.|{n} called me on Monday.|{n} was born in {c}.|{n} and {n} went home.|{n} lives in {c}.|{n} lives at {a}.|{n} said that the road was long.|{n}, born in May, came back.
{t} {n} is not here.|{t} {f} was at the meeting.|according to {n}, it rained.|a letter to {n} about the garden|the son of {n} came|{t} {f} and {t} {f} were late.
She lives at {a} in town.|He lives at {a} now.|They live at {a} by the river.|Ship the box to {a} today.|Send it to {a}, please.|Deliver to {a}, {c}|The office is at {a} since May.|Visit us at {a} or call.
My address is {a} in the old town.|Home address: {a}|Billing address: {a}|Address: {a}, {c}|The house at {a} was sold.|He moved to {a} last year.|{a}, {c}|from {a} to the river|She was seen near {a} on Monday.
Her SSN is {s} on file.|His SSN is {s}.|SSN: {s}|SSN {s}|SSN: {s}, verified.|SSN {s} is that of {n}.|social security number {s}|My social security number is {s}, he wrote.|The SSN {s} was given by {n}.
Passport number {p} was checked.|Passport number: {p}|Passport no. {p}|passport no. {p} expired|The passport number is {p} she wrote.|Passport {p} of {n}|ID card {p}|ID number: {p}|Driver licence {p} was shown.
"""
GIVEN = "Maria Jonas Aiko Peter Thomas Elena Samuel Clara David Ines Lucia Ivan Hannah Omar Lars Julia Paul Robert Anna George Karl Nina Ahmed Grace Victor Sofia Leon Emma Hugo Laura Felix Rosa Simon Eva Martin Alice"
FAMILY = "Keller Lindqvist Tanaka Novak Berger Rossi Okafor Jensen Cohen Moreau Fernandez Petrov Weber Haddad Nilsson Braun Meyer Lang Kowalska Miller Fischer Dubois Larsen Silva Andersen Costa Murray Walker Schmidt Richter"
STREETS = "Maple Oak Church Station Garden Lake Mill Harbour Hill Park Cedar Bridge King Queen River Market School Castle West North Elm Birch"
WAYS = "Street Avenue Lane Road Drive Court Way Place Square Close"
TOWNS = "Berlin London Paris Madrid Vienna Oslo Boston Lisbon Dublin Prague"
TITLES = "Mr. Mrs. Ms. Dr. Prof."
NOTHING = """
The meeting starts on Monday at the office.|The Street was empty and the road was long.|We live in a small town near the Lake.|Version 3 of the General Public License applies here.
Licensed under the Apache License, Version 2.0 as given.|Released under CC BY-SA 4.0 terms of use.|Call the number on the letter today.|The name of the river is not known.|Dear all, the report is on file.
Chapter 12 The Road To The North|Table 7 shows 480 rows and 39 columns.|It cost 1500 in May and 64 in June.|The number is 917 in the table.|On 12 May The Lake was calm.|It was the 5 of March when The Rain came.
token = 9f3a77b0c1d2e4|Contact us at the office or by letter.|In London the rain fell on Monday.|The Bank of the North opened in May.|They went to Paris and to Berlin.|Permission is hereby granted, free of charge, to any person
Copyright 2019 The Authors. All Rights Reserved.|THIS SOFTWARE IS PROVIDED AS IS|The Queen Of The River is a ship.|Monday and Tuesday are free.|See Section 4 of the Report.|Room 12 On The Left|The King spoke to the people.
He said that Spring Is Here.|Order 88 was sent in June.|She has 12 Red Boxes and 7 Blue Ones.|The address is not known.|Passport control is on the left.|Customer service is open.|The Garden was green, and Summer came.|Market day is on Friday.
"""
_SHAPE = [(re.compile(p), s) for p, s in ((rb"[A-Z]+", b"X"), (rb"[a-z]+", b"x"), (rb"[0-9]{3,}", b"D"), (rb"[0-9]+", b"d"), (rb"[\x80-\xff]+", b"x"), (rb"[!\"#$%&*+/<=>?@\[\]^_`{|}~\\]+", b"!"))]
_RUN = re.compile(rb"(.)\1+")
_CORE = re.compile(rb"[^A-Za-z]+")


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters, short and long digits as one sign each, marks as !, other signs once, at most 12."""
    for pattern, sign in _SHAPE:
        word = pattern.sub(sign, word)
    return _RUN.sub(rb"\1", word)[:12]


Sequence = tuple[list[bytes], list[int]]


def _marked(parts: list[tuple[str, str]]) -> Sequence:
    """Words and labels of a line of (text, kind or nothing) parts; a mark at a span's end stays on its last word."""
    words: list[str] = []
    labels: list[int] = []
    for text, kind in parts:
        glued = bool(words) and bool(text) and not text[0].isspace() and not kind
        for k, w in enumerate(text.split()):
            if k == 0 and glued and labels:
                words[-1] += w
                continue
            words.append(w)
            labels.append(LABELS.index(("I-" if k else "B-") + kind) if kind else 0)
    return [w.encode() for w in words], labels


def _made_up(rng: np.random.Generator, syllables: list[str]) -> str:
    return "".join(rng.choice(syllables, int(rng.integers(2, 4)))).capitalize()


def _filled(frame: str, rng: np.random.Generator, syllables: list[str]) -> Sequence:
    """A frame with its slots filled."""
    pick = lambda words: str(rng.choice(words.split()))
    own = lambda words: pick(words) if rng.random() < 0.5 else _made_up(rng, syllables)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letter = lambda: chr(65 + int(rng.integers(0, 26)))
    fill = {
        "n": lambda: " ".join([own(GIVEN), *([letter() + "."] if rng.random() < 0.1 else []), own(FAMILY)]),
        "f": lambda: own(FAMILY),
        "t": lambda: pick(TITLES),
        "a": lambda: f"{rng.integers(1, 10 ** int(rng.integers(1, 5)))} {own(STREETS)} {pick(WAYS)}",
        "c": lambda: pick(TOWNS),
        "s": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "p": lambda: (letter() + digits(7), letter() + digits(8), letter() + digits(2) + letter() + digits(2) + letter() + digits(1) + letter())[int(rng.integers(0, 3))],
    }
    kinds = {"n": "name", "f": "name", "a": "address", "s": "id", "p": "id"}
    return _marked([(fill[x[1]](), kinds.get(x[1], "")) if x[:1] == "{" else (x, "") for x in re.split(r"(\{\w\})", frame) if x])


def _labelled(fills: int = 8, plain: int = 1800) -> list[Sequence]:
    """The training table: each frame filled `fills` times, the lines without personal data, and invented prose."""
    rng = np.random.default_rng(6)
    syllables = "an the er on ti re in es or ha sta lo mi che de ra ou ver ge ment ar bo ku wen sil dra".split()
    table = [_filled(f, rng, syllables) for f in re.split(r"[|\n]", FRAMES.strip()) for _ in range(fills)]
    nothing = re.split(r"[|\n]", NOTHING.strip())
    table += [_marked([(line, "")]) for line in nothing for _ in range(3)]
    common = sorted({re.sub(r"\W", "", w.decode()).lower() for words, labels in table for w, y in zip(words, labels) if y == 0} - {"mr", "mrs", "ms", "dr", "prof", "ssn", ""})
    marks = "!\"#$%&'()*+,-./:;<=>?@[]^_|~"
    for k in range(plain):  # prose in every casing, with numbers, marks and common words in it: no personal data
        words = []
        for _ in range(int(rng.integers(3, 16))):
            w = "".join(rng.choice(syllables, int(rng.integers(1, 5)))) if rng.random() < 0.5 else str(rng.choice(common))
            begins = not words or words[-1][-1] in ".!?"
            w = w.upper() if k % 5 == 0 else w.capitalize() if rng.random() < (0.9 if begins and k % 2 else (0.25, 0.6, 0.1)[k % 3]) else w
            if rng.random() < 0.06:
                w = str(rng.integers(0, 10 ** int(rng.integers(1, 17))))
            if rng.random() < (0.1, 0.15, 0.2, 0.7)[k % 4]:  # every fourth line is full of marks
                w += rng.choice([",", "."]) if rng.random() < 0.5 else (rng.choice([",", "."]) if rng.random() < 0.3 else "") + rng.choice(list(marks)) * int(rng.integers(1, 4))
            words.append(w)
        if k % 7 == 0:  # and lines of repeated words
            words = [w for w in words[:4] for _ in range(int(rng.integers(2, 6)))]
        table.append(([w.encode() for w in words], [0] * len(words)))
    return table


class Field:
    """Linear-chain conditional random field. A word's emission scores come from its own features and its neighbours'.

    A feature is a shape or a word of the labelled table's lexicon; unseen shapes share one."""

    def __init__(self, features: dict[bytes, int], lexicon: dict[bytes, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.shapes, self.lexicon, self.emit, self.move = features, lexicon, emit, move
        self.ids: dict[bytes, int] = {}

    def id_of(self, word: bytes) -> int:
        return self.shapes.get(shape(word), 1) * (len(self.lexicon) + 1) + self.lexicon.get(_CORE.sub(b"", word).lower(), 0)

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        known = self.ids
        new = set(words) - known.keys()
        if len(known) + len(new) > 400_000:
            known.clear()
            new = set(words)
        known.update((w, self.id_of(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(labels, words): own, previous word's and next word's part; id 0 stands for a sequence's border."""
        n = len(self.lexicon) + 1
        s, w = ids // n, ids % n
        out = self.emit[0, s] + self.emit[1, w]
        for k, step in ((2, 1), (4, -1)):
            ns, nw = np.roll(s, step), np.roll(w, step)
            edge = starts if step == 1 else np.append(starts[1:], len(ids)) - 1
            ns[edge], nw[edge] = 0, 0
            out += self.emit[k, ns] + self.emit[k + 1, nw]
        return np.ascontiguousarray(out.T)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best labels of all sequences at once: step t handles the t-th word of every sequence that has one."""
    n_labels = len(move)
    labels = np.zeros(scores.shape[1], np.int8)
    order = np.argsort(-lengths, kind="stable")
    first, longest = starts[order], int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths[order], -np.arange(longest))  # sequences longer than t come first
    best = np.ascontiguousarray(scores[:, first])
    back = []
    for t in range(1, longest):
        m = int(alive[t])
        at = first[:m] + t
        if m <= FEW:
            paths = best[:, None, :m] + move[:, :, None]
            arg = paths.argmax(0).astype(np.int8)
            best[:, :m] = paths.max(0) + scores[:, at]
        else:
            arg, new = np.zeros((n_labels, m), np.int8), []
            for b in range(n_labels):
                top = best[0, :m] + move[0, b]
                for a in range(1, n_labels):
                    other = best[a, :m] + move[a, b]
                    better = other > top
                    arg[b][better] = a
                    np.maximum(top, other, out=top)
                new.append(top + scores[b, at])
            best[:, :m] = new
        if t % 64 == 0:  # sums of long lines would outgrow their precision
            best[:, :m] -= best[:, :m].max(0)
        back.append(arg)
    now = best.argmax(0)
    for t in range(longest - 1, -1, -1):
        m = int(alive[t])
        labels[first[:m] + t] = now[:m]
        if t:
            now[:m] = back[t - 1][now[:m], np.arange(m)]
    return labels


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained once in a process."""
    return train()


def train(rounds: int = 250, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Maximum likelihood with a small L2 penalty, by Adam on the whole table."""
    table = _labelled()
    shapes: dict[bytes, int] = {b"<edge>": 0, b"<other>": 1}
    counts: dict[bytes, int] = {}
    seen: dict[bytes, int] = {}
    for words, labels in table:
        for w, y in zip(words, labels):
            seen[shape(w)] = seen.get(shape(w), 0) + 1
            core = _CORE.sub(b"", w).lower()
            counts[core] = counts.get(core, 0) + (y == 0)
    for form, times in seen.items():  # the rare ones teach what an unseen shape is
        if times >= 4:
            shapes.setdefault(form, len(shapes))
    streets = {w.lower().encode() for w in WAYS.split()}
    lexicon = {w: k + 1 for k, w in enumerate(sorted({w for w, c in counts.items() if w and c >= 3 and len(w) < 12} | streets | {w.lower().encode() for w in GIVEN.split()}))}
    n, size = len(LABELS), max(len(shapes), len(lexicon) + 1)
    field = Field(shapes, lexicon, np.zeros((6, size, n)), np.zeros((n, n)))
    lengths = np.array([len(w) for w, _ in table])
    starts = np.cumsum(lengths) - lengths
    ids = field.ids_of([w for words, _ in table for w in words])
    gold = np.array([y for _, labels in table for y in labels])
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    s, w = ids // (len(lexicon) + 1), ids % (len(lexicon) + 1)
    parts = []
    for step in (0, 1, -1):
        ns, nw = np.roll(s, step), np.roll(w, step)
        if step:
            edge = starts if step == 1 else starts + lengths - 1
            ns[edge], nw[edge] = 0, 0
        for values in (ns, nw):  # sums by feature: rows in feature order, where each begins, which it is
            order = np.argsort(values, kind="stable")
            firsts = np.flatnonzero(np.diff(values[order], prepend=-1))
            parts.append((order, firsts, values[order][firsts]))
    moments = [np.zeros_like(field.emit), np.zeros_like(field.emit), np.zeros_like(field.move), np.zeros_like(field.move)]
    longest = int(lengths.max())
    grid = np.minimum(starts[:, None] + np.arange(longest), len(gold) - 1)
    alive = np.arange(longest) < lengths[:, None]
    for r in range(1, rounds + 1):
        e = field.scores(ids, starts).T[grid]  # sequences, steps, labels
        # Forward and backward in scaled probabilities: every step of alpha sums to 1, scale holds by how much.
        e = np.exp(e - e.max(2, keepdims=True))
        step = np.exp(field.move - field.move.max())
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(e.shape[:2])
        for t in range(longest):
            now = e[:, t] if t == 0 else alpha[:, t - 1] @ step * e[:, t]
            scale[:, t] = now.sum(1)
            alpha[:, t] = now / scale[:, t, None]
        ahead = np.zeros_like(e)  # what the next step brings: its emission, its beta and its scale
        for t in range(longest - 2, -1, -1):
            ahead[:, t] = e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
            beta[:, t] = np.where(alive[:, t + 1, None], ahead[:, t] @ step.T, 1)
        each = (alpha * beta)[alive]
        grad = np.zeros_like(field.emit)
        error = -each
        error[np.arange(len(gold)), gold] += 1
        for k, part in enumerate(parts):
            order, firsts, ids_of = part
            grad[k][ids_of] = np.add.reduceat(error[order], firsts, axis=0)
        on = alive[:, 1:]
        move = -step * (alpha[:, :-1][on].T @ ahead[:, :-1][on])
        np.add.at(move, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
        for value, g, m, v in ((field.emit, grad, *moments[:2]), (field.move, move, *moments[2:])):
            g = g / len(table) - decay * value
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += rate * (1 - r / rounds) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    field.emit = field.emit.astype(np.float32)
    field.move = field.move.astype(np.float32)
    field.ids = {}
    return field


Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def added_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """The field's spans of each text: decode all lines of all texts at once, then place the few labelled words."""
    words: list[bytes] = []
    sizes: list[int] = []
    lines: list[int] = []
    for text in texts:
        n = len(words)
        for line in text.encode().split(b"\n"):
            found = line.split()
            words += found
            lines += [len(found)] if found else []
        sizes.append(len(words) - n)
    out: list[list[Span]] = [[] for _ in texts]
    if not words:
        return out
    lengths = np.array(lines, np.int64)
    starts = np.cumsum(lengths) - lengths
    labels = viterbi(field.scores(field.ids_of(words), starts), starts, lengths, field.move)
    ends = np.cumsum(sizes)
    opens = np.zeros(len(words) + 1, bool)
    opens[starts] = True
    for doc in np.unique(np.searchsorted(ends, np.flatnonzero(labels), side="right")):
        places = [m.span() for m in WORD.finditer(texts[doc])]
        base = int(ends[doc]) - sizes[doc]
        last = None
        for k, y in enumerate(labels[base : ends[doc]]):
            if y == 0:
                last = None
                continue
            kind, (a, b) = LABELS[y][2:], places[k]
            b = a + len(texts[doc][a:b].rstrip(".,;:!?)\"'"))
            if last == kind and LABELS[y][0] == "I" and not opens[base + k]:
                out[doc][-1] = (kind, out[doc][-1][1], b)
            elif b > a:
                out[doc].append((kind, a, b))
            last = kind
    return out


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    result = []
    for text, more in zip(texts, added_spans(texts, field)):
        base = in_order(base_spans(text))
        result.append((base, in_order(base + [s for s in more if not any(x < s[2] and s[1] < y for _, x, y in base)])))
    return result


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = trained()
    weights = (field.shapes, field.lexicon, field.emit, field.move)

    def state() -> Field:
        store = worker_store("pii")
        if "field" not in store:
            store["field"] = Field(*weights)
        return store["field"]

    def step(batch: pa.RecordBatch, field: Field) -> pa.RecordBatch:
        rows = find([t or "" for t in batch.column(1).to_pylist()], field)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS[:4]],
                pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([said(spans) for _, spans in rows], pa.string()),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", step, state)
