"""Cutting texts into chunks whose tokens don't depend on their neighbours.

Under the split pattern of the byte-level vocabularies a token holds white space
only at its start, as one space, or consists of it. A place before a space that
other than white space follows is therefore always between two tokens, and
where no two white-space characters touch, so is each side of a line break.
Chunks between such places are encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BEFORE_WORD = re.compile(r"(?= \S)")
#: White space besides the space and the line break.
RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stands before a text's first piece; none of the texts cut at spaces has it.
FIRST = "\r"
#: Pieces without a word, where a text or line has none or a space ends the text.
SHORT = ("", "\n", FIRST)
#: New pieces encoded together, and ids kept for each piece that may be, on average.
TOGETHER, MOST = 4096, 8
#: Longest chunk kept in the cache, in characters.
LONGEST = 48


def touching(text: str) -> bool:
    """Whether white space may touch other white space."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(c in text for c in RARE)


class Cache(dict):
    """A mapping that computes missing values, in two generations of ``cap`` keys.

    When the young generation is full it becomes the old one; keys still in use
    come back from there. So at most 2 * cap keys are held.
    """

    def __init__(self, compute, cap: int):
        super().__init__()
        self.compute, self.cap, self.old = compute, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONGEST:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        """Keep a value."""
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Chunked:
    """Encodes texts by ``encode(chunk) -> bytes`` of chunks; bytes of a text are joined.

    Texts without touching white space are cut at their spaces, all of a list together and
    in columns: a piece is a word after a space, or begins with the line break before it, or
    with ``FIRST`` where its text does. Each distinct piece is looked up once, and the
    bytes of all are taken by number. ``encode_many(pieces) -> (ids, numbers of them)``, if there, gets
    many new pieces of one kind: all after a space, all after a line break, or all at a text's start.
    """

    def __init__(self, encode, encode_many=None, cap: int = 260_000):
        self.plain = Cache(encode, cap // 4)
        self.pieces = Cache(lambda p: encode(p[1:] if p[:1] == FIRST else p if p[:1] == "\n" else " " + p), cap)
        self.encode_many, self.cap = encode_many, 2 * cap
        self._empty()

    def _empty(self) -> None:
        """Forget what ``encode_many`` gave: numbers of pieces, their ids one after the other, and where each one's begin and end."""
        self.number: dict[str, int] = {}
        self.ids, self.edge = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def __call__(self, text: str) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        """Each text's encoding."""
        odd = {k for k, t in enumerate(texts) if touching(t)}
        even = iter(self._spaced([t for k, t in enumerate(texts) if k not in odd]))
        return [b"".join([self.plain[c] for c in _BEFORE_WORD.split(t)]) if k in odd else next(even) for k, t in enumerate(texts)]

    def _spaced(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = [FIRST + t.replace("\n", " \n") for t in texts]
        every = pc.split_pattern(pa.array([" ".join(cut)], pa.large_string()), " ").values.dictionary_encode()
        found = self._encoded(every.dictionary.to_numpy(zero_copy_only=False).tolist()).take(every.indices)
        at = np.cumsum([0, *[t.count(" ") + 1 for t in cut]])
        edge = np.frombuffer(found.buffers()[1], dtype=np.int64)[at].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(edge, edge[1:])]

    def _encoded(self, pieces: list[str]) -> pa.Array:
        """Encodings of distinct pieces."""
        if self.encode_many is None:
            have = self.pieces
            return pa.array([have[p] for p in pieces], pa.large_binary())
        if len(self.number) > self.cap or len(self.ids) > MOST * self.cap:
            self._empty()
        self._learn([p for p in pieces if p not in self.number])
        at = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        start = self.edge[at]
        size = self.edge[at + 1] - start
        edge = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(edge[-1]) + np.repeat(start - edge[:-1], size)]
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(4 * edge), pa.py_buffer(ids)])

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces together and number them."""
        after, line, first, short = [], [], [], []
        for p in new:
            (short if p in SHORT else line if p[0] == "\n" else first if p[0] == FIRST else after).append(p)
        ids, size = [self.ids], []
        for kind in (after, line, first):
            for i in range(0, len(kind), TOGETHER):
                got, n = self.encode_many(kind[i : i + TOGETHER])
                ids.append(got)
                size.append(n)
        got = [np.frombuffer(self.pieces[p], dtype="<u4") for p in short]
        size.append([len(x) for x in got])
        n = len(self.number)
        self.number.update(zip([*after, *line, *first, *short], range(n, n + len(new))))
        self.ids = np.concatenate([*ids, *got])
        self.edge = np.concatenate((self.edge, self.edge[-1] + np.cumsum(np.concatenate(size).astype(np.int64))))
