"""Definitions and references in program texts, by rules over lines and by level stacks.

A language is a list of rules (kind, pattern); a rule gives its first group for each
match in a line. Rules are data, so users add languages without code. What has to follow
a stack of levels (copybooks, YAML) is parsed a document at a time in Arrow batches.
Null texts have no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.operators.text import lines

JAVA = (
    ("package", r"^\s*package\s+([\w.]+)\s*;"),
    ("import", r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"),
    ("type", r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"),
    ("extends", r"\bextends\s+([A-Za-z_][\w.]*)"),
    ("implements", r"\bimplements\s+([A-Za-z_][\w.]*)"),
    ("method", r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\].,?]+\s+([a-zA-Z_]\w*)\s*\("),
    ("new", r"\bnew\s+([A-Z][\w.]*)\s*[(<]"),
)
SPRING = (
    ("component", r"@(?:Component|Service|Repository|Controller|RestController|Configuration)\(\s*\"([^\"]+)\""),
    ("inject", r"@Qualifier\(\s*\"([^\"]+)\""),
    ("route", r"@(?:Request|Get|Post|Put|Delete|Patch)Mapping\([^\"]*\"([^\"]+)\""),
    ("config_key", r"@Value\(\s*\"\$\{([^}:]+)"),
)
C = (
    ("include", r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"),
    ("define", r"^\s*#\s*define\s+([A-Za-z_]\w*)"),
    ("type", r"\b(?:struct|union|enum)\s+([A-Za-z_]\w*)\s*\{"),
    ("function", r"^[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;]*\)\s*\{"),
)
CSHARP = (
    ("namespace", r"^\s*namespace\s+([\w.]+)"),
    ("import", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
    ("type", r"\b(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)"),
    ("extends", r"\b(?:class|interface|struct|record)\s+\w+\s*:\s*([A-Za-z_][\w.]*)"),
    ("new", r"\bnew\s+([A-Z][\w.]*)\s*[(<{]"),
)
VB = (
    ("import", r"(?i)^\s*Imports\s+([\w.]+)"),
    ("type", r"(?i)^\s*(?:(?:Public|Private|Friend)\s+)?(?:Class|Module|Structure|Interface)\s+(\w+)"),
    ("method", r"(?i)^\s*(?:(?:Public|Private|Friend|Shared|Static)\s+)*(?:Sub|Function)\s+(\w+)"),
    ("extends", r"(?i)^\s*Inherits\s+([\w.]+)"),
    ("call", r"(?i)\bCall\s+([\w.]+)"),
)
SCRIPT = (
    ("import", r"\b(?:import\b[^'\"]*|require\(\s*)['\"]([^'\"]+)['\"]"),
    ("function", r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\("),
    ("script", r"(?i)<script[^>]*\bsrc\s*=\s*[\"']([^\"']+)"),
    ("link", r"(?i)<(?:a|link)\b[^>]*\bhref\s*=\s*[\"']([^\"']+)"),
    ("include", r"<%@\s*include\s+file\s*=\s*\"([^\"]+)\""),
)
XML = (
    ("bean", r"<bean\b[^>]*\bid\s*=\s*\"([^\"]+)\""),
    ("class", r"\b(?:class|type|resultType|parameterType)\s*=\s*\"([\w.$]+)\""),
    ("ref", r"\b(?:ref|bean)\s*=\s*\"([\w.-]+)\""),
    ("mapper", r"<mapper\b[^>]*\bnamespace\s*=\s*\"([\w.]+)\""),
    ("statement", r"<(?:select|insert|update|delete)\b[^>]*\bid\s*=\s*\"(\w+)\""),
    ("action", r"<action\b[^>]*\b(?:path|name)\s*=\s*\"([^\"]+)\""),
)
SQL = (
    ("table", r"(?i)\bCREATE\s+(?:GLOBAL\s+TEMPORARY\s+|TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)"),
    ("dropped", r"(?i)\b((?:ALTER\s+TABLE|CREATE\s+(?:OR\s+REPLACE\s+)?(?:VIEW|INDEX|SEQUENCE|TRIGGER))\s+[\w.\"]+)"),
    ("read", r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_\"][\w.\"]*)(?![\w.\"]*\s*\()"),
    ("write", r"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|TRUNCATE\s+TABLE)\s+([A-Za-z_\"][\w.\"]*)"),
)
#: Analyzer, its file extensions, the mark of a comment to the line's end, rules.
LANGUAGES = (
    ("java", ("java",), "//", JAVA + SPRING), ("c", ("c", "h"), "//", C), ("csharp", ("cs",), "//", CSHARP), ("vb", ("vb", "bas", "cls", "vbs"), "'", VB),
    ("script", ("js", "html", "jsp"), "//", SCRIPT), ("xml", ("xml",), None, XML), ("sql", ("sql", "ddl"), "--", SQL),
)


def code_lines(docs: DataFrame, mark: str | None = "//") -> DataFrame:
    """(doc_id, line, txt) without block comments and, outside strings, without what follows ``mark``."""
    s = lines(docs, "doc_id")
    bare = F.regexp_replace("txt", r'"(?:[^"\\]|\\.)*"', "")
    step = F.regexp_count(bare, F.lit(r"/\*")) - F.regexp_count(bare, F.lit(r"\*/"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("open", F.coalesce(F.sum(step).over(before), F.lit(0)))
    rest = F.when(F.instr("txt", "*/") > 0, F.substring_index(F.regexp_replace("txt", r"^.*?\*/", "\u0001"), "\u0001", -1)).otherwise("")
    txt = F.when(F.col("open") > 0, rest).otherwise(F.col("txt"))
    txt = F.regexp_replace(F.regexp_replace(txt, r"/\*.*?\*/", " "), r"/\*.*$", "")
    if mark:
        txt = F.regexp_replace(txt, rf'^((?:[^"]|"(?:[^"\\]|\\.)*")*?){re.escape(mark)}.*$', "$1")
    return s.select("doc_id", "line", txt.alias("txt"))


def scan(rows: DataFrame, rules) -> DataFrame:
    """(doc_id, line, kind, name) for every match of every rule (kind, pattern) in lines (doc_id, line, txt)."""
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"))
    found = [F.transform(F.regexp_extract_all("txt", F.lit(p), 1), named(k)) for k, p in rules]
    return rows.select("doc_id", "line", F.inline(F.flatten(F.array(*found)))).filter("name <> ''")


def analyze(files: DataFrame, languages=LANGUAGES) -> DataFrame:
    """(doc_id, line, kind, name, analyzer) of files (doc_id, path, text); the extension picks the analyzer."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    one = lambda name, exts, mark, rules: scan(code_lines(files.filter(ext.isin(*exts)), mark), rules).withColumn("analyzer", F.lit(name))
    return reduce(DataFrame.unionByName, [one(*x) for x in languages])


def table_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, table, nth, column) of CREATE TABLE statements; constraints are no columns."""
    plain = F.regexp_replace(F.regexp_replace("text", r"--[^\n]*", ""), r"(?s)/\*.*?\*/", " ")
    head = r"(?is)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"
    each = docs.select("doc_id", F.inline(F.arrays_zip(F.regexp_extract_all(plain, F.lit(head), 1).alias("table"), F.regexp_extract_all(plain, F.lit(head), 2).alias("body"))))
    # commas inside parentheses don't end a clause
    clauses = F.split(F.regexp_replace("body", r"\((?:[^()]|\([^()]*\))*\)", ""), ",")
    names = F.transform(clauses, lambda c: F.regexp_extract(c, r"^\s*\"?(\w+)", 1))
    names = F.filter(names, lambda n: (n != "") & ~F.upper(n).isin("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "KEY", "INDEX"))
    return each.select("doc_id", "table", F.posexplode(names).alias("nth", "column")).withColumn("nth", F.col("nth") + 1)


def cobol_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, txt): fixed-format lines without sequence area and comments, continuations joined."""
    s = lines(docs, "doc_id").withColumn("mark", F.substring("txt", 7, 1)).filter("mark NOT IN ('*', '/')")
    body = F.rtrim(F.substring("txt", 8, 65))
    more = F.col("mark") == "-"
    part = F.when(more, F.regexp_replace(body, r"^\s*[\"']?", "")).otherwise(body)
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("doc_id", "line", part.alias("part"), F.sum(F.when(more, 0).otherwise(1)).over(upto).alias("at"))
    g = s.groupBy("doc_id", "at").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "part"))).alias("p"))
    return g.select("doc_id", "line", F.array_join("p.part", "").alias("txt")).filter("trim(txt) <> ''")


def exec_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, kind, body) of EXEC SQL and EXEC CICS blocks, over any number of lines."""
    g = cobol_lines(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "txt"))), lambda x: x["txt"]), " ").alias("t"))
    p = F.lit(r"(?is)\bEXEC\s+(SQL|CICS)\s+((?:'[^']*'|[^'])*?)\s*END-EXEC")
    z = F.arrays_zip(F.transform(F.regexp_extract_all("t", p, 1), F.upper).alias("kind"), F.transform(F.regexp_extract_all("t", p, 2), lambda b: F.regexp_replace(b, r"\s+", " ")).alias("body"))
    return g.select("doc_id", F.posexplode(z).alias("nth", "x")).select("doc_id", (F.col("nth") + 1).alias("nth"), "x.kind", "x.body")


def data_flow(docs: DataFrame) -> DataFrame:
    """(doc_id, line, src, dst): items that MOVE and COMPUTE statements carry to others."""
    s = cobol_lines(docs).withColumn("u", F.upper("txt"))
    item = F.lit(r"([A-Z][A-Z0-9-]*)")
    move = s.select("doc_id", "line", F.array(F.regexp_extract("u", r"\bMOVE\s+([A-Z][A-Z0-9-]*)\s+TO\b", 1)).alias("a"), F.regexp_extract_all(F.regexp_extract("u", r"\bMOVE\s+[A-Z][A-Z0-9-]*\s+TO\s+([^.]*)", 1), item, 1).alias("b"))
    compute = s.select("doc_id", "line", F.regexp_extract_all(F.regexp_extract("u", r"\bCOMPUTE\s+[A-Z][A-Z0-9-]*\s*=\s*([^.]*)", 1), item, 1).alias("a"), F.array(F.regexp_extract("u", r"\bCOMPUTE\s+([A-Z][A-Z0-9-]*)", 1)).alias("b"))
    both = move.union(compute).select("doc_id", "line", F.explode("a").alias("src"), "b").select("doc_id", "line", "src", F.explode("b").alias("dst"))
    return both.filter("src <> '' AND dst <> ''").distinct()


#: Rows handed over together.
ROWS = 10_000


def by_document(docs: DataFrame, parse, fields: str) -> DataFrame:
    """Rows that ``parse(text)`` yields, behind their doc_id; one document at a time."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(fields).fields])

    def run(frames):
        for f in frames:
            rows = []
            for i, t in zip(f["doc_id"], f["text"]):
                rows += [(i, *r) for r in parse(t)]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=schema.names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return docs.select("doc_id", "text").filter("text IS NOT NULL").mapInPandas(run, schema)


_ITEM = re.compile(r"^(\d\d?)\s+([A-Z0-9][A-Z0-9-]*)?(.*)", re.S | re.I)
_VALUE = re.compile(r"\bVALUE\s+(?:IS\s+)?([+-]?\d+(?:\.\d+)?)", re.I)


def levels(text: str):
    stack: list[tuple[int, str]] = []
    for number, raw in enumerate(text.split("\n"), 1):
        body = raw[6:72] if raw[:6].strip(" 0123456789") == "" and len(raw) > 6 else raw
        hit = None if body[:1] in ("*", "/") else _ITEM.match(body.strip())
        level = int(hit[1]) if hit else 0
        if not hit or level in (66, 88):
            continue
        while stack and stack[-1][0] >= level:
            stack.pop()
        name = (hit[2] or "FILLER").upper()
        name = "" if name in ("FILLER", "PIC", "PICTURE") else name
        stack.append((level, name))
        if name:
            value = _VALUE.search(hit[3])
            yield number, level, name, ".".join(n for _, n in stack if n), value[1] if value else None


def copybook(docs: DataFrame) -> DataFrame:
    """(doc_id, line, level, name, key, value): items below their groups; fillers have no name."""
    return by_document(docs, levels, "line int, level int, name string, key string, value string")


_YAML = re.compile(r"^(\s*)(?:- )?([\w.-]+)\s*:(?:\s+(.*?))?\s*$")


def flattened(text: str):
    stack: list[tuple[int, str]] = []
    for number, raw in enumerate(text.split("\n"), 1):
        hit = None if raw.lstrip().startswith("#") else _YAML.match(raw)
        if not hit:
            continue
        indent = hit.start(2)
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, hit[2]))
        value = (hit[3] or "").split(" #")[0].strip().strip("\"'")
        if value:
            yield number, ".".join(k for _, k in stack), value


def yaml_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, line, key, value): dotted keys of YAML mappings."""
    return by_document(docs, flattened, "line int, key string, value string")


def row_groups(docs: DataFrame, rows: int = 20, row_bytes: int = 7600, chars: int = 1000) -> DataFrame:
    """(doc_id, first, last, kind, bytes): runs of table rows, and of body paragraphs, cut where they grow too long."""

    def cut(text: str):
        first = last = count = size = letters = 0
        kind = None
        for number, raw in enumerate(text.split("\n"), 1):
            now = "row" if raw.lstrip().startswith("|") else "body" if raw.strip() else kind if kind == "body" else None
            n = len(raw.encode("utf-8", "replace"))
            full = count >= rows or size + n > row_bytes if now == "row" else letters + len(raw) > chars
            if kind and (now != kind or full):
                yield first, last, kind, size
                kind = None
            if now and raw.strip():
                if kind is None:
                    kind, first, count, size, letters = now, number, 0, 0, 0
                last, count, size, letters = number, count + 1, size + n, letters + len(raw)
        if kind:
            yield first, last, kind, size

    return by_document(docs, cut, "first int, last int, kind string, bytes long")
