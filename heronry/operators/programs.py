"""Facts in program texts, all of a file in one pass.

A fact is a row (doc_id, path, line, role, kind, name, a, b, n). Roles are

* def: a definition of ``kind`` and name; a: the whole name where it has a longer one;
* ref: a reference to a ``kind``; a: the type of the edge that it makes, b: the path as written, or the definition around it;
* io: an external file of a program; kind r, w or rw, name as in the program, a: the data-definition name;
* dd: a data definition of a job's step; kind dataset or temporary, name the definition's, a: the data set, b: its relative generation, n: the line of the step's EXEC;
* use: a name in a program's procedure part, at its first line;
* note: what is there but not followed, by its reason.

Files are read by their extension. COBOL and job control have readers of their own, copybooks that of
``code``, all other languages the rules of ``code.LANGUAGES`` over the text without comments, so that
declarations over several lines are found. Null texts have no facts.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heronry.operators import code

FIELDS = "line int, role string, kind string, name string, a string, b string, n int"
#: Steps of these programs run no program of the user's.
UTILITIES = frozenset("IEFBR14 IEBGENER ICEGENER IEBCOPY IEBCOMPR IEBPTPCH IEBUPDTE IEBDG IDCAMS SORT ICEMAN SYNCSORT DFSORT ADRDSSU IKJEFT01 IKJEFT1B IRXJCL".split())
#: How OPEN opens, what statements do to the file that they name, and words that may stand between.
OPENS = {"INPUT": "r", "OUTPUT": "w", "EXTEND": "w", "I-O": "rw"}
TOUCHES = {"READ": "r", "START": "r", "WRITE": "w", "REWRITE": "w", "DELETE": "w"}
BETWEEN = frozenset(("WITH", "NO", "REWIND", "SHARING", "REVERSED"))
SORTS = frozenset(("SORT", "MERGE", "RELEASE", "RETURN"))
DIVISIONS = frozenset(("IDENTIFICATION", "ID", "ENVIRONMENT", "DATA", "PROCEDURE"))
SECTIONS = frozenset(("CONFIGURATION", "INPUT-OUTPUT", "FILE", "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE", "SCREEN", "REPORT", "COMMUNICATION"))

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z0-9][\w-]*|\.(?=\s|$)")
_SEQUENCE = re.compile(r"[0-9 ]{6}|[A-Za-z0-9]{6}")
_TABLES = re.compile(r"(?i)\b(?:(FROM|JOIN)|(INTO|UPDATE))\s+([A-Za-z_][\w.]*)")
_CICS = re.compile(r"(?i)\b(?:LINK|XCTL|START)\b.*?\bPROGRAM\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")


def bodies(text: str) -> list[tuple[int, str]]:
    """(line, code) of COBOL: without sequence area, comments and what follows column 72; continued lines are joined to the first."""
    out: list[tuple[int, str]] = []
    for number, raw in enumerate(text.split("\n"), 1):
        raw = raw.rstrip("\r")
        if len(raw) > 6 and _SEQUENCE.match(raw) and raw[6] in " */-dD":
            mark, body = raw[6], raw[7:72]
        else:
            mark, body = ("*" if raw.lstrip()[:1] == "*" else " "), raw
        if mark in "*/" or not body.strip():
            continue
        if mark == "-" and out:
            first, before = out[-1]
            more = body.lstrip()
            opened = before.count("'") % 2 or before.count('"') % 2
            out[-1] = first, before.rstrip() + (more[1:] if opened and more[:1] in "'\"" else " " * (not opened) + more)
        else:
            out.append((number, body.split("*>")[0]))
    return out


def _between(lines: list, first: tuple, last: tuple) -> str:
    """The code from one place (index of the line, column) to another."""
    (a, x), (b, y) = first, last
    if a == b:
        return lines[a][1][x:y]
    return "\n".join([lines[a][1][x:], *[t for _, t in lines[a + 1 : b]], *([lines[b][1][:y]] if b < len(lines) else [])])


def _plain(word: str) -> str:
    return word.strip("'\"").upper()


def cobol(text: str, book: str | None = None):
    """Facts of a program, or with ``book`` of the copybook of that name: its items and copies."""
    lines_ = bodies(text)
    tokens = [(line, m[0], m[0].upper(), (k, m.start())) for k, (line, body) in enumerate(lines_) for m in _TOKEN.finditer(body)]
    zone, fd, wait, begun = "", None, None, book is not None
    selects: dict = {}
    opened: dict = {}
    touched: dict = {}
    sorts: set = set()
    records: dict = {}
    names: set = set()
    k, last = 0, len(tokens)
    at = lambda i: tokens[i][2] if i < last else ""
    if book is not None:
        yield 1, "def", "copybook", book, None, None, None
        for line, _, name, key, _ in code.levels(text):
            yield line, "def", "item", name, key, None, None
    while k < last:
        line, raw, word, _ = tokens[k]
        k += 1
        if (at(k) == "DIVISION" and word in DIVISIONS) or (at(k) == "SECTION" and word in SECTIONS) or word in ("FILE-CONTROL", "I-O-CONTROL"):
            zone, fd, wait, k = word, None, None, k + (at(k) in ("DIVISION", "SECTION"))
        elif word == "PROGRAM-ID":
            while at(k) == ".":
                k += 1
            if k < last:
                begun, zone = True, ""
                yield line, "def", "program", _plain(at(k)), None, None, None
                k += 1
        elif not begun:
            continue
        elif word == "COPY" and k < last and at(k) != ".":
            yield line, "ref", "copybook", _plain(at(k)), "INCLUDES", None, None
            k += 1
        elif word == "EXEC" and at(k) in ("SQL", "CICS"):
            end = next((i for i in range(k, last) if at(i) == "END-EXEC"), last)
            block = _between(lines_, tokens[k][3], tokens[end][3] if end < last else (len(lines_), 0))
            if at(k) == "CICS":
                for program in _CICS.findall(block):
                    yield line, "ref", "program", program.upper(), "INVOKES", None, None
            elif at(k + 1) == "INCLUDE":
                yield line, "ref", "copybook", at(k + 2), "INCLUDES", None, None
            else:
                for read, _, table in _TABLES.findall(re.sub(r"(?is)\bINTO\s*:.*?(?=\bFROM\b)", " ", block)):
                    yield line, "ref", "table", table.upper(), "READS" if read else "WRITES", None, None
            k = end + 1
        elif zone == "FILE-CONTROL" and word == "SELECT":
            end = next((i for i in range(k, last) if at(i) == "."), last)
            words = [t[1] for t in tokens[k:end]]
            upper = [w.upper() for w in words]
            if upper[:1] == ["OPTIONAL"]:
                words, upper = words[1:], upper[1:]
            if "ASSIGN" in upper[1:]:
                to = upper.index("ASSIGN") + 1
                to += upper[to : to + 1] == ["TO"]
                target = words[to] if to < len(words) else ""
                if target[:1] in ("'", '"'):
                    yield line, "note", "assign_literal", upper[0], None, None, None
                elif not target or upper[to] in ("USING", "DYNAMIC"):
                    yield line, "note", "assign_dynamic", upper[0], None, None, None
                else:
                    selects[upper[0]] = (upper[to].split("-")[-1] or upper[to])[:8]
            k = end
        elif zone == "FILE" and word in ("FD", "SD") and k < last:
            fd = at(k)
            if word == "SD":
                sorts.add(fd)
                yield line, "note", "sort_file", fd, None, None, None
            k += 1
        elif zone == "FILE" and word in ("01", "1") and fd and at(k) not in ("", ".", "FILLER"):
            records.setdefault(at(k), fd)
        elif zone == "" and word == "SELECT" and at(k) != "":  # a fragment without divisions
            zone, k = "FILE-CONTROL", k - 1
        else:
            if zone == "PROCEDURE" and raw[0] not in "'\".":
                if not word.isdigit() and word not in names:
                    names.add(word)
                    yield line, "use", "item", word, None, None, None
                state, wait = wait, None
                if word == "OPEN":
                    wait = ("open", "")
                elif state and state[0] == "open" and (word in OPENS or word in BETWEEN):
                    wait = ("open", OPENS.get(word, state[1]))
                elif state and state[0] == "open" and word in selects:
                    opened.setdefault(word, [set(), line])[0].update(state[1])
                    wait = state
                elif state and state[0] == "touch":
                    file = word if word in selects else records.get(word)
                    if file in selects:
                        touched.setdefault(file, [set(), line])[0].update(state[1])
                elif state and state[0] == "sort" and (word in selects or word in records):
                    yield line, "note", "sort_statement", word, None, None, None
                elif word in TOUCHES:
                    wait = ("touch", TOUCHES[word])
                elif word in SORTS:
                    wait = ("sort", "")
            if word == "CALL" and k < last:
                if at(k)[0] in "'\"":
                    yield line, "ref", "program", _plain(at(k)), "INVOKES", None, None
                else:
                    yield line, "note", "dynamic_call", at(k), None, None, None
    for file, dd in selects.items():
        modes, line = opened.get(file) or touched.get(file) or (None, 0)
        if modes and file not in sorts:
            yield line, "io", "rw" if len(modes) == 2 else min(modes), file, dd, None, None


_PARAMETER = re.compile(r"(?:'(?:[^']|'')*'|\((?:[^()]|\([^()]*\))*\)|[^,'(])+")
_OPERANDS = re.compile(r"(?:'(?:[^']|'')*'|[^\s'])*")
_GENERATION = re.compile(r"(.+)\(([+-]?\d+)\)$")


def statements(text: str) -> list[tuple[int, str, str, str]]:
    """(line, name, operation, operands) of job control; operands that end in a comma go on in the next statement line."""
    out: list[list] = []
    for number, raw in enumerate(text.split("\n"), 1):
        raw = raw.rstrip("\r")[:72].rstrip()
        if not raw.startswith("//") or raw.startswith("//*"):
            continue
        if out and out[-1][3].endswith(",") and raw[2:3] == " ":
            out[-1][3] += _OPERANDS.match(raw[2:].lstrip())[0]
            continue
        name = re.match(r"\S*", raw[2:])[0]
        operation, _, rest = raw[2 + len(name) :].strip().partition(" ")
        out.append([number, name.upper(), operation.upper(), _OPERANDS.match(rest.lstrip())[0]])
    return [tuple(x) for x in out]


def job_control(text: str):
    """Facts of jobs and procedures."""
    step = None  # line and name of the EXEC whose data definitions count
    dd, seen = "", {}
    for line, name, operation, operands in statements(text):
        given = [p.partition("=") for p in _PARAMETER.findall(operands)]
        values = {key.strip().upper(): value.strip() for key, eq, value in given if eq}
        if operation in ("JOB", "PROC", "PEND", ""):
            step, dd = None, ""
            if operation in ("JOB", "PROC") and name:
                yield line, "def", operation.lower(), name, None, None, None
        elif operation == "EXEC":
            step, dd = None, ""
            program = values.get("PGM", "").upper()
            procedure = (values.get("PROC") or (given[0][0].strip() if given and not given[0][1] else "")).upper()
            called = program or procedure
            if called and "&" in called:
                yield line, "note", "symbolic", called, None, None, None
            elif program:
                if program in UTILITIES:
                    yield line, "note", "utility_step", program, None, None, None
                else:
                    step = (line, name)
                yield line, "ref", "program", program, "EXECUTES", None, line
            elif procedure:
                yield line, "ref", "proc", procedure, "EXECUTES", None, None
        elif operation == "INCLUDE":
            member = values.get("MEMBER", "").strip("()").upper()
            if member:
                yield line, "ref", "member", member, "INCLUDES", None, None
        elif operation == "DD":
            if "." in name:
                yield line, "note", "dd_override", name, None, None, None
                continue
            dd = name or dd
            dsn = (values.get("DSN") or values.get("DSNAME") or "").upper()
            if dsn[:1] == "'" == dsn[-1:] and len(dsn) > 1:
                dsn = dsn[1:-1].replace("''", "'")
            if step is None or not dd or not dsn:
                continue
            generation = None
            if dsn.startswith("*."):
                back = dsn[2:].split(".")
                found = seen.get((back[0], back[-1]) if len(back) > 1 else (step[1], back[0]))
                if found is None:
                    yield line, "note", "dsn_backref_unresolved", dsn, None, None, None
                    continue
                dsn, generation = found
            elif "&" in dsn and not dsn.startswith("&&"):
                yield line, "note", "dsn_symbolic", dsn, None, None, None
                continue
            elif not dsn.startswith("&&") and (m := _GENERATION.match(dsn)):
                dsn, generation = m[1], m[2]
            seen[step[1], dd] = dsn, generation
            yield line, "dd", "temporary" if dsn.startswith("&&") else "dataset", dd, dsn, generation, step[0]


#: What the rules of a language find: (analyzer, rule) to (role, kind, type of edge).
MEANING = {
    ("java", "type"): ("def", "type", None), ("java", "method"): ("def", "method", None), ("java", "extends"): ("ref", "type", "EXTENDS"), ("java", "implements"): ("ref", "type", "IMPLEMENTS"),
    ("java", "new"): ("ref", "type", "USES"), ("java", "import"): ("ref", "type", "IMPORTS"), ("java", "component"): ("def", "bean", None), ("java", "inject"): ("ref", "bean", "INJECTS"),
    ("java", "route"): ("def", "route", None), ("java", "config_key"): ("ref", "config", "READS"),
    ("c", "include"): ("ref", "file", "INCLUDES"), ("c", "type"): ("def", "type", None), ("c", "function"): ("def", "function", None), ("c", "define"): ("def", "macro", None),
    ("c", "declared"): ("def", "declaration", None), ("c", "call"): ("ref", "function", "CALLS"),
    ("csharp", "type"): ("def", "type", None), ("csharp", "extends"): ("ref", "type", "EXTENDS"), ("csharp", "new"): ("ref", "type", "USES"),
    ("vb", "type"): ("def", "type", None), ("vb", "method"): ("def", "function", None), ("vb", "extends"): ("ref", "type", "EXTENDS"), ("vb", "call"): ("ref", "function", "CALLS"),
    ("script", "function"): ("def", "function", None), ("script", "import"): ("ref", "file", "IMPORTS"), ("script", "script"): ("ref", "file", "INCLUDES"), ("script", "link"): ("ref", "file", "LINKS"), ("script", "include"): ("ref", "file", "INCLUDES"),
    ("xml", "bean"): ("def", "bean", None), ("xml", "class"): ("ref", "type", "USES"), ("xml", "ref"): ("ref", "bean", "INJECTS"), ("xml", "mapper"): ("ref", "type", "USES"), ("xml", "statement"): ("def", "statement", None), ("xml", "action"): ("def", "route", None),
    ("sql", "table"): ("def", "table", None), ("sql", "read"): ("ref", "table", "READS"), ("sql", "write"): ("ref", "table", "WRITES"),
    ("shell", "source"): ("ref", "file", "INCLUDES"), ("shell", "call"): ("ref", "file", "RUNS"),
}
#: Rules that look at a whole text, beside those of ``code``.
MORE = {
    "c": (("declared", r"(?m)^[A-Za-z_][\w \t*]*?\b([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*;"), ("call", r"\b([A-Za-z_]\w*)\s*\((?=[^{]*?;)")),
    "shell": (("source", r"(?m)^\s*(?:\.|source)\s+(\S+)"), ("call", r"(?m)^\s*(?:(?:ba|k)?sh\s+)?(\S+\.(?:k?sh|bash))(?=\s|$)")),
}
#: Words before a bracket that call nothing.
NO_CALL = frozenset("if for while switch return sizeof do else case defined".split())
EXTENSIONS = {e: (name, mark, rules) for name, exts, mark, rules in code.LANGUAGES for e in exts} | {e: ("shell", "#", ()) for e in ("sh", "ksh", "bash")}
_compiled: dict[str, list] = {}


def bare(text: str, mark: str | None) -> str:
    """The text with comments blanked; lines and places stay."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    line = rf"|{re.escape(mark)}[^\n]*" if mark else ""
    block = r"|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)" if mark != "#" else ""
    return re.sub(rf'"(?:[^"\\\n]|\\.)*"{block}{line}', lambda m: m[0] if m[0][0] == '"' else blank(m[0]), text, flags=re.S)


def by_rules(text: str, analyzer: str, mark: str | None, rules) -> list:
    """Facts by a language's rules; a call belongs to the function before it."""
    if analyzer not in _compiled:
        _compiled[analyzer] = [(k, re.compile(p, re.M)) for k, p in (*rules, *MORE.get(analyzer, ()))]
    clean = bare(text, mark)
    starts = [0, *(m.end() for m in re.finditer("\n", clean))]
    found = sorted((m.start(1), kind, m.group(1)) for kind, p in _compiled[analyzer] for m in p.finditer(clean) if m.group(1))
    own = {at for at, kind, _ in found if kind in ("function", "declared", "define", "type")}
    out, inside, table = [], None, None
    for at, kind, name in found:
        meaning = MEANING.get((analyzer, kind))
        if meaning is None or (kind == "call" and (at in own or name in NO_CALL)):
            continue
        role, what, edge = meaning
        whole = name.strip('"')
        if what == "function" and role == "def":
            inside = whole
        short = re.split(r"[./\\$]" if what in ("type", "function") else r"[/\\]" if what == "file" else r"\.(?=[^.]*$)" if what == "table" else r"\0", whole)[-1]
        if short in ("*", ""):
            continue
        more = whole if what in ("file", "type", "table") and whole != short else None
        out.append((bisect_right(starts, at), role, what, short, edge if role == "ref" else more, (inside if what == "function" else more) if role == "ref" else None, None))
        table = table or what
    return out


def facts(files: DataFrame) -> DataFrame:
    """All facts of files (doc_id, path, text), and each file of a language with rules as a definition of kind file."""
    schema = T.StructType([files.schema["doc_id"], files.schema["path"], *T.StructType.fromDDL(FIELDS).fields])

    def parse(path: str, text: str):
        base = path.rsplit("/", 1)[-1]
        stem, _, ext = base.rpartition(".")
        ext = ext.lower()
        if ext in ("cbl", "cob", "cobol"):
            yield from cobol(text)
        elif ext in ("cpy", "copy"):
            yield from cobol(text, stem.upper())
        elif ext == "jcl":
            yield from job_control(text)
        elif ext in ("yaml", "yml"):
            for line, key, _ in code.flattened(text):
                yield line, "def", "config", key, None, None, None
        elif ext == "properties":
            for m in re.finditer(r"(?m)^[ \t]*([^#!=:\s][^=:\s]*)[ \t]*[=:]", text):
                yield text.count("\n", 0, m.start(1)) + 1, "def", "config", m[1], None, None, None
        elif ext in EXTENSIONS:
            name, mark, rules = EXTENSIONS[ext]
            yield 0, "def", "file", base, None, None, None
            yield from by_rules(text, name, mark, rules)

    def run(frames):
        for f in frames:
            rows = []
            for i, p, t in zip(f["doc_id"], f["path"], f["text"]):
                if p is not None and t is not None:
                    rows += [(i, p, *r) for r in parse(p, t)]
                if len(rows) >= code.ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=schema.names)
        return out.astype({"line": "int32", "n": "Int32"})

    return files.select("doc_id", "path", "text").mapInPandas(run, schema)
