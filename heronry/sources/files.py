"""Folders of files as DataFrames: bytes, decoded texts, archive members and Office contents.

Spark lists and reads the files (binaryFile), so any store will do; each file is one
row, and what a row holds is read inside a task. Limits bound what one file may unpack
to; a file beyond them, or broken, gives one row whose ``error`` says so, and no others.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of version control, which are never read.
VCS = (".git", ".svn", ".hg", ".bzr", "CVS")
#: Largest file, largest sum of its members and most members.
FILE_BYTES, UNPACKED_BYTES, MEMBERS = 64 << 20, 256 << 20, 10_000
#: Share of undecodable characters from which an encoding counts as undetermined.
GARBLED = 0.02


def read_folder(spark: SparkSession, folder: str, pattern: str | None = None, largest: int = FILE_BYTES) -> DataFrame:
    """(path, length, modified, content) of all files below ``folder``, none of version control; content of larger ones is null. Spark's reader leaves empty files out."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    f = (r.option("pathGlobFilter", pattern) if pattern else r).load(folder)
    kept = ~F.exists(F.split("path", "/"), lambda s: s.isin(*VCS))
    return f.filter(kept).select("path", "length", F.col("modificationTime").alias("modified"), F.when(F.col("length") <= largest, F.col("content")).alias("content"))


def decode(data: bytes) -> tuple[str, float, str, str]:
    """(encoding, share of garbled characters, quality, text) of bytes.

    A byte-order mark decides, then strict UTF-8; else the Japanese encoding, or UTF-8
    itself, with the fewest replaced characters, UTF-8 if equal. Quality: ok, partial,
    or undetermined (too many garbled characters, or most lines that aren't blank).
    """
    if data.startswith(b"\xef\xbb\xbf"):
        tried = [("utf-8-sig", data.decode("utf-8-sig", "replace"))]
    else:
        tried = [(e, data.decode(e, "replace")) for e in ("utf-8", "cp932", "euc_jp")]
        if "�" not in tried[0][1] or b"\xef\xbf\xbd" in data:
            tried = tried[:1]
    name, text = min(tried, key=lambda x: x[1].count("�"))
    bad = text.count("�") / max(1, len(text))
    rows = [x for x in text.split("\n") if x.strip()]
    most = sum("�" in x for x in rows) * 2 > len(rows)
    return name, bad, "ok" if not bad else "undetermined" if bad > GARBLED or most else "partial", text


def _each(files: DataFrame, read, fields: str) -> DataFrame:
    """Rows that ``read(content)`` yields for each file, behind its path and before ``error``."""
    schema = T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(fields).fields, T.StructField("error", T.StringType())])
    blank = [None] * (len(schema) - 2)

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    if content is None:
                        raise ValueError("too large")
                    rows = [(path, *r, None) for r in read(bytes(content))]
                except (ValueError, KeyError, OSError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile, tarfile.TarError, ElementTree.ParseError) as e:
                    rows = [(path, *blank, f"{type(e).__name__}: {e}"[:200])]
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names).astype(object)

    return files.select("path", "content").mapInPandas(run, schema)


def texts(files: DataFrame) -> DataFrame:
    """(path, encoding, garbled, quality, text, error): one row per file."""
    return _each(files, lambda b: [decode(b)], "encoding string, garbled double, quality string, text string")


def _safe(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in re.split(r"[/\\]", name) and ":" not in name.split("/")[0]


def _open_zip(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if len(z.infolist()) > MEMBERS or sum(i.file_size for i in z.infolist()) > UNPACKED_BYTES:
        raise ValueError("unpacks to too much")
    return z


def _members(data: bytes):
    if zipfile.is_zipfile(io.BytesIO(data)):
        z = _open_zip(data)
        for i in z.infolist():
            if not i.is_dir() and _safe(i.filename):
                yield i.filename, i.file_size, z.read(i)
        return
    total = 0
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for n, i in enumerate(t):
            total += i.size
            if n >= MEMBERS or total > UNPACKED_BYTES:
                raise ValueError("unpacks to too much")
            if i.isfile() and _safe(i.name):
                yield i.name, i.size, t.extractfile(i).read()


def members(files: DataFrame) -> DataFrame:
    """(path, member, length, content, error) of zip and tar archives; links and names that leave the folder are left out."""
    return _each(files, _members, "member string, length long, content binary")


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _under(e, name: str):
    return (x for x in e.iter() if _local(x) == name)


def _text(e, name: str = "t") -> str:
    return "".join(x.text or "" for x in _under(e, name))


def _attribute(e, name: str):
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def column_number(letters: str) -> int:
    """1 for A, 27 for AA."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _cells(data: bytes):
    z = _open_zip(data)
    names = set(z.namelist())
    shared = [_text(s) for s in _under(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in _under(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
        link = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
        for c in _under(ElementTree.fromstring(z.read("xl/" + targets[link])), "c"):
            kind, ref = c.get("t"), c.get("r") or ""
            value = _text(c, "v")
            value = _text(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
            place = re.fullmatch(r"([A-Z]+)([0-9]+)", ref)
            if value and place:
                yield sheet.get("name"), ref, int(place[2]), column_number(place[1]), value


def cells(files: DataFrame) -> DataFrame:
    """(path, sheet, ref, row, col, value, error): cells of workbooks that hold a value."""
    return _each(files, _cells, "sheet string, ref string, row int, col int, value string")


def _paragraphs(data: bytes):
    root = ElementTree.fromstring(_open_zip(data).read("word/document.xml"))
    for n, p in enumerate(_under(root, "p"), 1):
        text = _text(p)
        style = next((_attribute(s, "val") for s in _under(p, "pStyle")), None)
        struck = "".join(_text(r) for r in _under(p, "r") if any(_attribute(s, "val") not in ("0", "false") for k in ("strike", "dstrike") for s in _under(r, k)))
        if text:
            yield n, style, text, struck or None


def paragraphs(files: DataFrame) -> DataFrame:
    """(path, nth, style, text, struck, error): paragraphs of word documents and the part of each that is struck through."""
    return _each(files, _paragraphs, "nth int, style string, text string, struck string")


def _slides(data: bytes):
    z = _open_zip(data)
    found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide([0-9]+)\.xml", n)))
    for number, name in found:
        for k, p in enumerate(_under(ElementTree.fromstring(z.read(name)), "p"), 1):
            if text := _text(p):
                yield number, k, text


def slides(files: DataFrame) -> DataFrame:
    """(path, slide, nth, text, error): paragraphs of presentations."""
    return _each(files, _slides, "slide int, nth int, text string")


def _markdown(data: bytes):
    names = set(_open_zip(data).namelist())
    if "xl/workbook.xml" in names:
        out, at = [], None
        for sheet, _, row, _, value in _cells(data):
            if sheet != (at and at[0]):
                out.append(f"## {sheet}\n")
            out.append(" | ".join(out.pop().split(" | ") + [value]) if at == (sheet, row) else value)
            at = (sheet, row)
        yield ("\n".join(x if x.startswith("## ") else f"| {x} |" for x in out),)
    elif "word/document.xml" in names:
        level = lambda s: "#" * int(s[-1]) + " " if s and re.fullmatch(r"Heading[1-6]", s) else ""
        yield ("\n\n".join(level(style) + text for _, style, text, _ in _paragraphs(data)),)
    else:
        out, at = [], None
        for number, _, text in _slides(data):
            out.append(f"## Slide {number}\n\n{text}" if number != at else text)
            at = number
        yield ("\n\n".join(out),)


def markdown(files: DataFrame) -> DataFrame:
    """(path, text, error): workbooks, word documents and presentations as Markdown."""
    return _each(files, _markdown, "text string")
