"""DuckDB inside tasks: SQL over the rows of an Arrow batch, in bounded memory."""

from __future__ import annotations

import zlib

import duckdb
import pyarrow as pa

#: Characters of texts that one SQL statement gets, about; whole texts only.
CHARS = 2_000_000
#: The letters that the contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32s(values):
    """CRC-32 of each string's UTF-8 bytes."""
    return pa.array([None if v is None else zlib.crc32(v.encode()) for v in values.to_pylist()], pa.int64())


def connect(memory: str = "600MB") -> duckdb.DuckDBPyConnection:
    """A database in memory: one thread, no files; ``crc32`` is zlib's."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": "", "preserve_insertion_order": False})
    con.create_function("crc32", crc32s, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def words_sql(pattern: str, texts: str, keep: str = "row") -> str:
    """Words of ``texts`` (keep, text) with their places, A-Z lower-cased; each keeps the columns ``keep``."""
    return f"SELECT {keep}, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT {keep}, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}') AS words FROM {texts})"
