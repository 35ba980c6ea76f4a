"""Token ids in bit-packed files, in ascending order of document id.

Format of a file, in this order; integers are little-endian:

* 8 bytes ``MAGIC``, then bits an id and ids a block, 32 bits each;
* blocks: ids of all documents one after the other, cut after ``block`` ids and
  packed into the minimum of bits that the vocabulary needs, lowest bit first;
* the table: numbers of documents, blocks and documents without id (the first ones), then the documents' ids, the
  position of each one's first id in the file and after all of them the number
  of ids, and the byte offset of each block, 64 bits each;
* the table's length in bytes, 64 bits, and ``MAGIC``.

A line break follows each of these parts, since Spark's text writer writes them;
offsets count it. Spark writes and reads the files (text and binaryFile), so any
store that it reaches will do; a reader finds a document's blocks by the table
and unpacks only these.

Rows go by range of doc_id, and of a hash of the text where ids are equal, to files of about ``FILE_BYTES`` of
text and are sorted there; Spark numbers the files in that order.
A document's start is its position in its file plus the ids of all files before;
those sums are over files, not documents. The strings of special tokens in a text become
these tokens, as the library has it.

A null text counts as empty, so that only the end id remains; a null doc_id sorts
first and comes back as null; repeated ids keep one entry for each row, ordered by the text's hash; other
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.chunks import FIRST, Chunked
from heronry.llm.common import materialise, new_folder, sliced, small_batches

MAGIC = b"HRNIDS01"
TOKENIZER, END = public_tokenizers.path("byte_bpe_50k.json"), 2
BLOCK, FILE_BYTES = 65_536, 32 << 20
#: Documents read back together.
STEP = 1024
#: Fixed value: how byte-level vocabularies write a space.
SPACE = "\u0120"


def width(vocabulary: int) -> int:
    """Bits that ids below ``vocabulary`` need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def write_parts(docs, bits: int, block: int = BLOCK):
    """Parts of one file for (doc_id, ids) pairs in order; holds one block and the table."""
    head = MAGIC + np.array([bits, block], dtype="<u4").tobytes()
    yield head
    at, held, kept = len(head) + 1, 0, []
    names, starts, offsets, total, nulls = [], [0], [], 0, 0
    for name, ids in docs:
        nulls += name is None
        names.append(name or 0)
        total += len(ids)
        starts.append(total)
        kept.append(ids)
        held += len(ids)
        if held >= block:
            every = np.concatenate(kept)
            full = held - held % block
            for i in range(0, full, block):
                part = pack(every[i : i + block], bits)
                offsets.append(at)
                at += len(part) + 1
                yield part
            kept, held = [every[full:]], held - full
    if held:
        offsets.append(at)
        yield pack(np.concatenate(kept), bits)
    table = b"".join(np.array(x, dtype="<i8").tobytes() for x in ([len(names), len(offsets), nulls], names, starts, offsets))
    yield table + len(table).to_bytes(8, "little") + MAGIC


class File:
    """Reads a file's bytes; ids are unpacked when asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-9:-1] != MAGIC:
            raise ValueError("not a token file, or cut off")
        self.data = data
        self.bits, self.block = map(int, np.frombuffer(data, "<u4", 2, 8))
        size = int.from_bytes(data[-17:-9], "little")
        table = np.frombuffer(data, "<i8", size // 8, len(data) - 17 - size)
        n, blocks, nulls = map(int, table[:3])
        self.names = [None] * nulls + table[3 + nulls : 3 + n].tolist()
        self.starts, self.offsets = table[3 + n : 4 + 2 * n], table[4 + 2 * n : 4 + 2 * n + blocks]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.between(int(self.starts[k]), int(self.starts[k + 1]))

    def between(self, first: int, last: int) -> np.ndarray:
        """Ids at positions [first, last)."""
        total, parts = int(self.starts[-1]), []
        for b in range(first // self.block, -(-last // self.block)):
            n = min(self.block, total - b * self.block)
            at = int(self.offsets[b])
            part = unpack(self.data[at : at + -(-n * self.bits // 8)], self.bits, n)
            parts.append(part[max(0, first - b * self.block) : last - b * self.block])
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


_ready: dict[str, tuple] = {}


def encoder(path: str):
    """This process's tokenizer: texts to ids packed as 32-bit integers, and the vocabulary's size."""
    if path not in _ready:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        ids_of = lambda text: np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")  # noqa: E731  without the places in the text
        one = lambda chunk: ids_of(chunk).tobytes()
        begins = np.zeros(t.get_vocab_size(), dtype=bool)
        begins[[i for token, i in t.get_vocab().items() if token.startswith(SPACE)]] = True

        line = np.frombuffer(one("\n"), dtype="<u4")

        def many(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Ids of pieces of one kind, and how many each has. The library splits the joined pieces where they meet: before each token that begins with a space, or at line breaks."""
            start = pieces[0][0]
            if len(line) == 1 or start not in ("\n", FIRST):
                if start == FIRST:
                    ids = ids_of("\n".join([p[1:] for p in pieces]))
                    cut = ids == line[0]
                    size = np.diff(np.flatnonzero(cut), prepend=-1, append=len(ids)) - 1
                    ids = ids[~cut]
                elif start == "\n":
                    ids = ids_of("".join(pieces))
                    size = np.diff(np.flatnonzero(ids == line[0]), append=len(ids))
                else:
                    ids = ids_of(" " + " ".join(pieces))
                    size = np.diff(np.flatnonzero(begins[ids]), append=len(ids))
                if len(size) == len(pieces):
                    return ids, size
            each = [ids_of(p[1:] if start == FIRST else p if start == "\n" else " " + p) for p in pieces]
            return np.concatenate(each), np.array([len(x) for x in each])

        chunked = Chunked(one, many)
        special = {a.content: (i, a) for i, a in t.get_added_tokens_decoder().items()}
        plain = not any(a.lstrip or a.rstrip or a.single_word for _, a in special.values())
        cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else re.compile("(?!)")

        def with_special(text: str) -> bytes:
            """The library encodes what lies between the strings of special tokens by itself."""
            if not plain:
                return one(text)
            parts = cut.split(text)
            return b"".join(np.uint32(special[x][0]).astype("<u4").tobytes() if k % 2 else chunked(x) if x else b"" for k, x in enumerate(parts))

        def encode(texts: list[str]) -> list[bytes]:
            odd = {k for k, x in enumerate(texts) if any(c in x for c in special)}
            found = iter(chunked.all([x for k, x in enumerate(texts) if k not in odd]))
            return [with_special(x) if k in odd else next(found) for k, x in enumerate(texts)]

        _ready[path] = encode, t.get_vocab_size()
    return _ready[path]


def write_files(docs: DataFrame, to: str, path: str = TOKENIZER, end: int | None = END, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode and write all of ``docs`` below ``to``; files and rows in ascending id order."""
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    files = max(1, -(-(two.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0) // file_bytes))
    schema = T.StructType([T.StructField("part", T.BinaryType())])
    tail = np.array([] if end is None else [end], dtype=np.uint32)

    def run(batches):
        encode, size = encoder(path)

        def each():
            for b in batches:
                for names, texts in sliced(b, chars=1_000_000):
                    for name, got in zip(names.to_pylist(), encode(texts)):
                        yield name, np.concatenate((np.frombuffer(got, dtype="<u4"), tail))

        rows = each()
        first = next(rows, None)
        if first is None:
            return
        for part in write_parts(chain([first], rows), width(size)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])

    small_batches(docs.sparkSession)
    dealt = two.withColumn("h", F.xxhash64("t")).repartitionByRange(files, "id", "h").sortWithinPartitions("id", "h")
    dealt.select("id", "t").mapInArrow(run, schema).select(F.col("part").cast("string").alias("value")).write.option("compression", "none").text(to)
    return to


def read_files(spark, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start, n_tokens, ids_crc32."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("part", id_col, "at", "n_tokens", "ids_crc32")])

    def run(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                f = File(data.as_buffer().to_pybytes())
                n = len(f.names)
                for i in range(0, n, STEP):
                    j = min(n, i + STEP)
                    base = int(f.starts[i])
                    ids = f.between(base, int(f.starts[j])).astype("<u4")
                    crc = [zlib.crc32(ids[int(f.starts[k]) - base : int(f.starts[k + 1]) - base]) for k in range(i, j)]
                    cols = [[part] * (j - i), f.names[i:j], f.starts[i:j], np.diff(f.starts[i : j + 1]), crc]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=schema.names)

    files = spark.read.format("binaryFile").load(folder).filter(F.col("length") > 0).select(F.regexp_extract("path", r".*part-(\d+)", 1).cast("long").alias("part"), "content")
    rows = materialise(files.mapInArrow(run, schema), "token-rows")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(offsets, "part").select(id_col, (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, to: str | None = None, **how) -> DataFrame:
    """Write the files, to a new folder of the shared one unless named, and report from them."""
    spark = docs.sparkSession
    folder = write_files(docs, to or new_folder(spark, "token-files"), **how)
    return read_files(spark, folder, how.get("id_col", "doc_id"))
