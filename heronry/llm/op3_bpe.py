"""Byte-level BPE encoding and decoding, with exact merges in linear time.

Tokens are mapped byte by byte to Latin-1 and put into an Aho-Corasick
automaton, which lists in one pass over a piece the longest token at each of its
positions. Encoding goes from left to right, takes the longest token that fits
behind the last one, falls back to its longest proper prefix that is a token, and
if none is left steps back over the last token; each position is given up at
most once, so the work stays linear.

Two adjacent tokens fit if no merge ever crosses the border between them. The
parts next to the border over time are the right spine of the first token and
the left spine of the second one, where a part lives until the rank of the merge
that swallows it. A merge of two such parts happens if its rank is below the
first one's end and not above the second one's (equal merges go from left to
right). Answers are memoised by pair.

A null text counts as empty, without ids; ids of rows may be null or repeat; other
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heronry.llm.chunks import Chunked
from heronry.llm.common import id_field, map_texts

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NEVER = 1 << 60
#: Pairs remembered at most.
MEMO = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.text = {i: t.decode("latin-1") for i, t in self.token.items()}
        self.direct = {t: i for i, t in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        self.prefix: dict[int, int] = {}
        self.length: dict[int, int] = {}
        for i, t in self.text.items():
            self.automaton.add_word(t, i)
            self.length[i] = len(t)
            self.prefix[i] = next((self.direct[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.direct), -1)
        self.automaton.make_automaton()
        self.halves = {i: self._halves(t) for t, i in ranks.items()}
        self.right = {i: self._spine(i, 1) for i in self.token}
        self.left = {i: self._spine(i, 0) for i in self.token}
        self.memo: dict[tuple[int, int], bool] = {}
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, i: int, side: int) -> list[tuple[bytes, int]]:
        """Parts at one edge of a token with the rank that ends each."""
        out, end = [], NEVER
        while True:
            out.append((self.token[i], end))
            halves = self.halves[i]
            if halves is None:
                return out
            end, i = i, self.ranks[halves[side]]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a."""
        known = self.memo.get((a, b))
        if known is None:
            get = self.ranks.get
            known = not any((z := get(x + y, NEVER)) < x_end and z <= y_end and z < NEVER for x, x_end in self.right[a] for y, y_end in self.left[b])
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[a, b] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the split pattern; ``piece`` is its UTF-8 as Latin-1."""
        whole = self.direct.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        length, prefix, fits = self.length, self.prefix, self.fits
        longest = [-1] * n
        for end, i in self.automaton.iter(piece):
            longest[end - length[i] + 1] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[at + length[token]] and (last < 0 or fits(last, token))):
                token = prefix[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                if not out:
                    raise ValueError("a byte has no token")
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
                token = prefix[token]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return [i for m in split(text) for i in self.encode_piece(m.encode("utf-8", "surrogatepass").decode("latin-1"))]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([self.packed[i] for i in self.encode(text)])

    def decode(self, ids) -> bytes:
        """Bytes of ids."""
        return b"".join(map(self.token.__getitem__, ids))


PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Code points that this regex module's newer tables call letters or
#: numbers, and those of the library (Unicode 16) don't.
NEWER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2,
    0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5,
    0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1), (0x1246f, 0x1246f), (0x12475, 0x1247f),
    (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80,
    0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81),
    (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe,
    0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")


def split(text: str) -> list[str]:
    """Matches of the split pattern."""
    if text.isascii() or not _NEWER.search(text):
        return PATTERN.findall(text)
    ends = [m.end() for m in PATTERN.finditer(_NEWER.sub("\u2603", text))]
    return [text[a:b] for a, b in zip([0, *ends], ends)]


_ready: dict[str, tuple[Bpe, Chunked]] = {}


def encoder(path: str) -> tuple[Bpe, Chunked]:
    """This process's encoder for a rank file, and the same by chunks."""
    if path not in _ready:
        bpe = Bpe(read_ranks(path))
        _ready[path] = bpe, Chunked(bpe.encode_packed)
    return _ready[path]


def bpe_encode(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``ids`` packed as 32-bit integers, and ``decoded`` from them."""
    schema = T.StructType([id_field(docs, id_col), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def work(ids, texts):
        bpe, chunked = encoder(path)
        packed = chunked.all(texts)
        return {id_col: ids, "ids": packed, "decoded": [bpe.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in packed]}

    return map_texts(docs, work, schema, id_col, text_col)


def digest(ids: list[int]) -> str:
    """The hash of ids, as the query derives it."""
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
