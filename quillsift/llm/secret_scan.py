"""Secret scans: fixed patterns plus sliding-window entropy per character class.

Base kinds (assign, access, hex) are patterns. Further candidates are long runs of token characters, less what base spans
cover; for each character class a window slides over what is left of a run, Shannon entropy is kept up to date from counts
(one character in, one out), and a window above the class's bits adds that piece as a span, unless the allow-list knows it.
Words of one case, plain numbers and the like hold too few kinds of characters to be one. Spans are in code points, end
exclusive.

Defined results: null texts are empty; each row is scanned alone, so repeated rows give equal results; an empty table gives
an empty one; extra columns are ignored; a text of any length is scanned whole, in time that grows with its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillsift.llm.common import arrow_batches

#: The base patterns and the shortest match that counts (assign: its second group).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN, MIN_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: (name, characters, bits that a window must reach)
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.2),
    ("alnum", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 3.7),
    ("base64", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"), 3.7),
)
#: Shapes that are known not to be secrets: UUIDs, plain words, numbers, snake or kebab words.
KINDS_OF_CHARACTERS = tuple(re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]"))
ALLOWED = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[A-Z]?[a-z]+|[A-Z]+|[0-9+=_-]+|(?:[A-Za-z]+[-_/=+]+)+[A-Za-z]*")
_LOG = [0.0, 0.0, *(n * math.log2(n) for n in range(2, WINDOW + 1))]


def mixed(piece: str) -> bool:
    """Two kinds of characters at least; a digit, or letters of both cases as often as chance mixes them."""
    lower, upper, digit = (len(kind.findall(piece)) for kind in KINDS_OF_CHARACTERS)
    return bool(digit and lower + upper) or min(lower, upper) * 4 >= len(piece)


def window_entropy(run: str, chars: frozenset[str], width: int = WINDOW) -> float:
    """Highest entropy in bits of a window of `width` characters of one class within run; -1 without such a window.

    With counts c of a full window, entropy is log2(width) - sum(c log2 c) / width; each step changes two counts.
    """
    counts: dict[str, int] = {}
    total, held, best = 0.0, 0, math.inf
    for i, ch in enumerate(run):
        if ch not in chars:
            counts, total, held = {}, 0.0, 0
            continue
        if held == width:
            old = run[i - width]
            total += _LOG[counts[old] - 1] - _LOG[counts[old]]
            counts[old] -= 1
        else:
            held += 1
        n = counts.get(ch, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[ch] = n + 1
        if held == width:
            best = min(best, total)
    return -1.0 if best is math.inf else math.log2(width) - best / width


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the entropy of a window adds: pieces of runs that no base span covers."""
    out: list[tuple[int, int, int]] = []
    cover = merged(taken)
    k = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(cover) and cover[k][1] <= start:
            k += 1
        j = k
        while start < end:
            hit = cover[j] if j < len(cover) and cover[j][0] < end else (end, end)
            piece = text[start : max(hit[0], start)]
            if len(piece) >= WINDOW and mixed(piece) and not ALLOWED.fullmatch(piece) and any(window_entropy(piece, chars) >= bits for _, chars, bits in CLASSES):
                out.append((start, 3, start + len(piece)))
            start = max(start, hit[1])
            j += 1
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches that spans cover, rising."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, base digest, all spans) of a text."""
    text = text or ""
    base = base_spans(text)
    every = sorted(base + entropy_spans(text, base))
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row of SCHEMA per document."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return scan(docs)
