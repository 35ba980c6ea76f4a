import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm import op3_bpe as op

BPE, CHUNKED = op.encoder(op.VOCABULARY)
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
piece = st.one_of(st.sampled_from(["the", " ", "  ", "\n", "\t", "\xa0", "é", "ß", "ing", "'s", "12", "!!", "\x1c", "\x85", "\r\n", "日本", "\u3000", "\U0001f600", "x" * 40]), st.text(max_size=4))


@settings(max_examples=500, deadline=None)
@given(st.lists(piece, max_size=25).map("".join))
def test_equals_library(text):
    want = LIB.encode_ordinary(text)
    assert BPE.encode(text) == want
    assert np.frombuffer(CHUNKED(text), "<u4").tolist() == want
    assert BPE.decode(want) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text("abcdr", min_size=1, max_size=60))
def test_small_vocabulary_against_plain_merging(text):
    ranks = {bytes([b]): b for b in range(256)}
    for i, t in enumerate((b"ab", b"ra", b"abra", b"ca", b"da", b"cada", b"bc", b"dr", b"aa", b"aaa", b"aaaa")):
        ranks[t] = 256 + i
    b = op.Bpe(ranks)
    parts = [text[i : i + 1].encode() for i in range(len(text))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    assert b.encode_piece(text) == [ranks[p] for p in parts]


def test_rows(spark):
    rows = [(1, None, 3), (2, "", 4), (3, "héllo  wörld\n\n", 5), (3, "héllo  wörld\n\n", 5), (None, "ab" * 200_000, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = op.bpe_encode(d).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "", 2: "", 3: rows[2][1], None: rows[4][1]}[r.doc_id]
        assert bytes(r.decoded) == text.encode()
        assert hashlib.sha256(bytes(r.ids)).hexdigest() == op.digest(LIB.encode_ordinary(text))
    assert op.bpe_encode(d.limit(0)).collect() == []
