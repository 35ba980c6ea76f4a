"""Secret scanning: fixed patterns, and sliding-window entropy over candidates.

Texts of a batch are joined as UTF-8 with a separator that no class contains, so
each pattern runs once over the whole batch; offsets become code points by the
number of continuation bytes before them.

The entropy method looks at maximal runs of token characters of at least
``MIN_RUN``. A candidate belongs to one character class (hex digits, or the
base64 alphabet); a window of that class's width slides over it, the counts of
the entering and leaving character being the only ones to change, and the sum of
n*log2(n) is updated with them. Windows at or above the class's threshold are
joined to spans, unless the allow list names the candidate.

Defined results: a null text counts as empty and has no spans; ids may be null
or repeat, each row gives one row; other columns aren't read; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heronry.llm.common import byte_table, id_field, map_texts

#: Kinds of spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "entropy")
#: The patterns; the first one is used on lower-cased bytes.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = byte_table(b"0123456789abcdef")
TOKEN = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN, MIN_RUN = 12, 18, 16, 20
#: By class, the width of the window and the least entropy in bits.
CLASSES = {"hex": (20, 3.0), "base64": (20, 3.7)}
#: Candidates that are no secrets.
ALLOW = re.compile(
    rb"""(?ix)
    ^[a-z_-]+$                                        # words without digits
    | ^[0-9_-]+$                                      # numbers and dates
    | ^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$   # UUID
    | ^(?:[a-z]+[/_-])+[a-z]+[0-9]{0,4}$              # paths of words
    """
)
#: Words that make a span no secret if they stand in it.
ALLOW_WORDS = re.compile(rb"(?i)example|sample|dummy|placeholder|changeme")
_HEXDIGITS = frozenset(b"0123456789abcdefABCDEF")


def entropy_spans(run: bytes) -> list[tuple[int, int]]:
    """Spans of ``run`` whose windows reach the class's entropy, but for those with a word of the allow list."""
    if ALLOW.search(run):
        return []
    width, least = CLASSES["hex" if _HEXDIGITS.issuperset(run) else "base64"]
    if len(run) < width:
        return []
    log = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts = [0] * 256
    total = 0.0  # the sum of n*log2(n)
    top = math.log2(width)
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        if i >= width:
            n = counts[run[i - width]]
            total += log[n - 1] - log[n]
            counts[run[i - width]] = n - 1
        n = counts[c]
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        if i >= width - 1 and top - total / width >= least - 1e-9:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return [x for x in spans if not ALLOW_WORDS.search(run, *x)]


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least ``least``."""
    edge = np.diff(np.concatenate(([0], member.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind's rank, end), sorted; code points."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = b"\x00".join(raw) + b"\x00"
    data = np.frombuffer(buf, dtype=np.uint8)
    offset = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offset[1:])
    found: list[tuple[int, int, int]] = []  # start, kind, end in bytes
    found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(buf.lower()) if m.end(1) - m.start(1) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(buf) if m.end() - m.start() >= ACCESS_MIN]
    found += [(int(s), 2, int(e)) for s, e in zip(*_runs(HEX[data], HEX_MIN))]
    for s, e in zip(*_runs(TOKEN[data], MIN_RUN)):
        found += [(int(s) + a, 3, int(s) + b) for a, b in entropy_spans(buf[s:e])]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not found:
        return out
    at = np.array(found, dtype=np.int64)
    doc = np.searchsorted(offset, at[:, 0], side="right") - 1
    points: dict[int, np.ndarray] = {}  # of texts beyond ASCII, the code points before each byte
    for k, (s, kind, e) in zip(doc.tolist(), found):
        r, base = raw[k], int(offset[k])
        if len(r) == len(texts[k]):
            out[k].append((s - base, kind, e - base))
        else:
            if k not in points:
                begins = (data[base : base + len(r)] & 0xC0) != 0x80
                points[k] = np.cumsum(begins) - begins
            first = int(points[k][s - base])
            out[k].append((first, kind, first + e - s))
    return [sorted(x) for x in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and its spans as an array of (kind, start, end)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([id_field(docs, id_col), T.StructField("found", T.ArrayType(span))])

    def work(ids, texts):
        return {id_col: ids, "found": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in scan(texts)]}

    return map_texts(docs, work, schema, id_col, text_col)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The hash of the base spans, as the query derives it."""
    return hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest()
