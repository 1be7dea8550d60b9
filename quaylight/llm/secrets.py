"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

A candidate is a long run of token characters. For each character class, the parts of the candidate inside the class
are scanned by a window whose symbol counts are updated by one symbol in and one out; windows above the class's
threshold are joined to spans. Four classes: hexadecimal digits; lower-case letters with digits; letters of both cases
without digits; all token characters with a digit among them. Runs of letters of one case are words and
in no class; paths and identifiers without digits are only scanned for long parts of letters of both cases.

The allow-list (a parameter) suppresses in two ways. A word of it drops the part of a run that holds it, parts being cut
at / _ = and -, and the rest of the run is scanned as if it stood alone. A form of it drops what it matches as a whole:
a run, or a span. Spans that a pattern or an earlier class has found already are left out.

Defined results: a null text is an empty one and has no spans; offsets are code points, end exclusive; texts and runs of
any length are scanned whole, in one pass a class; every row gives one row, repeated ones too; an empty table gives no
rows; only doc_id and text are read, other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quaylight.llm.common import map_batches

# The patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_lower", "entropy_letters", "entropy_base64")
#: One of these is in every text with an assign match, whatever the case of its letters.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

WINDOW = 20
_SEPARATOR = re.compile("[/_=-]")
#: Class name: its runs and the bits per symbol a window must exceed.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 3.1),
    "entropy_lower": (re.compile(r"(?<![a-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{20,}"), 3.6),
    "entropy_letters": (re.compile(r"(?<![A-Za-z])(?=[a-z]*[A-Z])(?=[A-Z]*[a-z])[A-Za-z]{20,}"), 4.0),
    "entropy_base64": (re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"), 3.8),
}


class Allow(NamedTuple):
    """What is no secret: words that mark their part of a run, and forms of whole runs or spans."""

    words: tuple[str, ...] = ("EXAMPLE", "example", "PLACEHOLDER", "placeholder", "deadbeef", "xxxx", "XXXX")
    #: Digits and separators only (dates, versions), UUIDs.
    forms: tuple[str, ...] = (r"[0-9_/+=-]+", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")

    def compiled(self) -> tuple[re.Pattern, re.Pattern]:
        return tuple(re.compile("|".join(parts) or r"(?!)") for parts in (map(re.escape, self.words), (f"(?:{f})" for f in self.forms)))


ALLOW = Allow()
_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # one symbol comes in before one goes

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in CANDIDATE.finditer(text):  # access and hex matches of the wanted length lie inside such a run
        a, b = run.span()
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return in_order(found)


def dense_windows(part: str, bits: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of part whose entropy exceeds bits; each step changes two counts."""
    counts: dict[str, int] = {}
    inner, out = 0.0, []
    limit = math.log2(window) - bits
    for i, c in enumerate(part):
        n = counts.get(c, 0)
        inner += _PLOGP[n + 1] - _PLOGP[n]
        counts[c] = n + 1
        if i >= window:
            gone = part[i - window]
            n = counts[gone]
            inner += _PLOGP[n - 1] - _PLOGP[n]
            counts[gone] = n - 1
        if i >= window - 1 and inner / window < limit - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _dropped(run: str, words: re.Pattern) -> list[tuple[int, int]]:
    """The parts of a run, from separator to separator, that hold a word."""
    out: list[tuple[int, int]] = []
    for m in words.finditer(run):
        low = out[-1][1] if out else 0
        if m.start() >= low:
            end = _SEPARATOR.search(run, m.end())
            out.append((max(low, *(run.rfind(c, low, m.start()) + 1 for c in "/_=-")), end.start() if end else len(run)))
    return out


def entropy_spans(text: str, known: list[Span], allow: tuple[re.Pattern, re.Pattern] = ALLOW.compiled()) -> list[Span]:  # noqa: B008
    found: list[Span] = []
    words, forms = allow
    for run in CANDIDATE.finditer(text):
        if forms.fullmatch(run[0]):
            continue
        # What is left of the run between the parts that the allow-list drops.
        cuts = _dropped(run[0], words)
        for a, b in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(run[0])]):
            base = run.start() + a
            part = run[0][a:b]
            for kind, (members, bits) in CLASSES.items() if b - a >= WINDOW else ():
                for m in members.finditer(part):
                    for x, y in dense_windows(m[0], bits):
                        span = (kind, base + m.start() + x, base + m.start() + y)
                        covered = any(p <= span[1] and span[2] <= q for _, p, q in [*known, *found])
                        if not covered and not forms.fullmatch(text, span[1], span[2]):
                            found.append(span)
    return found


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(text: str, allow: tuple[re.Pattern, re.Pattern] = ALLOW.compiled()) -> tuple[list[Span], list[Span]]:  # noqa: B008
    """(base spans, all spans)."""
    base = base_spans(text)
    return base, in_order(base + entropy_spans(text, base, allow))


def scan_secrets(docs: DataFrame, allow: Allow = ALLOW) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    listed = allow.compiled()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [find(t or "", listed) for t in batch.column(1).to_pylist()]
        counts = [[sum(s[0] == kind for s in base) for base, _ in rows] for kind in KINDS[:3]]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([said(spans) for _, spans in rows], pa.string()),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", step)
