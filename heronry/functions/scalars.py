"""Column expressions: names, paths, scopes, kinds, masks, vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closed vocabularies of file kinds.
CODE_EXT = (
    "py", "cbl", "cob", "cpy", "jcl", "sql", "java", "c", "h", "cs", "vb", "js", "sh", "bat", "ts", "cpp", "hpp", "pl", "ps1", "psm1", "go", "rb", "php", "kt", "swift", "scala", "lua", "r", "awk",
    "ini", "cfg", "conf", "json", "toml",
)
DOC_EXT = ("md", "txt", "docx", "xlsx", "pptx", "pdf", "html", "csv", "tsv", "rtf", "log")
NOISE_EXT = ("tmp", "bak", "swp", "lock")
SECRET_EXT = ("key", "pem", "ppk", "env")
SECRET_NAMES = (".env", ".netrc", ".npmrc", ".git-credentials")
SECRET_BEGINS = (".env.", "id_rsa", "credentials")
VCS_DIRS = (".git", ".svn", ".hg", ".bzr", "CVS")


def code_name(c: Column) -> Column:
    """Trimmed, without dots at the end, upper case; null is empty."""
    return F.upper(F.rtrim(F.trim(F.coalesce(c, F.lit(""))), F.lit(".")))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(path: Column) -> Column:
    """Lower-case text behind the last dot of the name; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def ancestors(path: Column) -> Column:
    """a/b/c.md -> [a, a/b]."""
    p, n = parts(path), F.size(parts(path))
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Path at or below one of the scopes, at a segment's end; none means all."""
    found = F.lit(not scopes)
    for s in scopes:
        found = found | (path == s) | F.startswith(path, F.lit(s + "/"))
    return found


def normalise_scopes(c: Column) -> Column:
    """Trimmed, without empty ones, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def file_class(path: Column) -> Column:
    """code, document or null by extension."""
    e = extension(path)
    return F.when(e.isin(*CODE_EXT), "code").when(e.isin(*DOC_EXT), "document")


def is_noise(path: Column) -> Column:
    return extension(path).isin(*NOISE_EXT) | F.startswith(base_name(path), F.lit("~$"))


def is_secret_name(path: Column) -> Column:
    """By extension, whole name or beginning of the name, either case."""
    name = F.lower(base_name(path))
    found = extension(path).isin(*SECRET_EXT) | name.isin(*SECRET_NAMES)
    for begin in SECRET_BEGINS:
        found = found | F.startswith(name, F.lit(begin))
    return found


def has_vcs_dir(path: Column) -> Column:
    """Any folder on the way is a version-control one; exact, case-sensitive."""
    return F.exists(F.slice(parts(path), F.lit(1), F.size(parts(path)) - 1), lambda s: s.isin(*VCS_DIRS))


def in_layer(path: Column, layer: str) -> Column:
    """Rows of a layer (docs, code or both); rows of unknown kind pass."""
    if layer == "both":
        return F.lit(True)
    return F.coalesce(file_class(path) == ("code" if layer == "code" else "document"), F.lit(True))


def tree_distance(a: Column, b: Column) -> Column:
    """Steps between the folders of two paths by their common ancestor."""
    x, y = F.slice(parts(a), F.lit(1), F.size(parts(a)) - 1), F.slice(parts(b), F.lit(1), F.size(parts(b)) - 1)
    both = F.least(F.size(x), F.size(y))
    same = F.when(both > 0, F.size(F.filter(F.sequence(F.lit(1), both), lambda i: F.slice(x, F.lit(1), i) == F.slice(y, F.lit(1), i)))).otherwise(F.lit(0))
    return F.size(x) + F.size(y) - 2 * same


def canonical_id(label: Column, world: Column, path: Column, name: Column) -> Column:
    return F.concat(label, F.lit(":"), world, F.lit(":"), path, F.lit("#"), name)


def csv_safe(c: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@\t\r\n＝＋－＠]"), F.concat(F.lit("'"), c)).otherwise(c)


def redact(c: Column) -> Column:
    """Access keys and values of secret-like names masked."""
    c = F.regexp_replace(c, r"AKIA[A-Z0-9]{12,}", "[redacted]")
    return F.regexp_replace(c, r"(?i)(password|passwd|secret|token)( *[:=] *)[^\s]+", "$1$2[redacted]")


def period_number(c: Column) -> Column:
    """The first run of digits, full-width ones included."""
    return F.regexp_extract(F.translate(c, "０１２３４５６７８９", "0123456789"), r"[0-9]+", 0).try_cast("long")


def glob_regex(pattern: str) -> str:
    """A segment glob as a regular expression on lower-case paths; without a slash any depth."""
    pattern, out, i = pattern.lower(), "", 0
    pattern = pattern if "/" in pattern else "**/" + pattern
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            if c == "[" and (end := pattern.find("]", i + 2)) > 0:
                inner = pattern[i + 1 : end]
                out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    return f"^{out}$"


def valid_vector(v: Column, dim: int) -> Column:
    """Exact size, finite, norm above zero."""
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0), F.lit(False))


def quantise(v: Column) -> Column:
    """Scaled to 127 by the largest magnitude, rounded half away from zero."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: (F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double")) * (F.lit(127.0) / top) + 0.5)).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Divided by its length."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / n)


#: Every end of line: as a pattern of Java.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def top_folder(path: Column) -> Column:
    """First folder; null for files at the root."""
    return F.when(F.contains(path, F.lit("/")), F.element_at(parts(path), 1))


def clip_bytes(text: Column, n: int) -> Column:
    """The longest beginning of at most ``n`` bytes of UTF-8 that cuts no character."""
    raw = F.encode(text, "UTF-8")
    inside = lambda back: F.hex(F.substring(raw, n + 1 - back, 1)).rlike("^[89AB]")  # noqa: E731  a byte within a character
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.substr(raw, F.lit(1), F.lit(n) - back), "UTF-8"))


def sniff(text: Column) -> Column:
    """binary, code or document by content, first rule that holds."""
    n = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, LINE_END), lambda x: x.rlike(r"\S"))
    share = lambda rule: F.size(F.filter(lines, rule)) / F.greatest(F.size(lines), F.lit(1))
    return (
        F.when(F.length(text) == 0, "document")
        .when(F.contains(text, F.lit("PRIVATE KEY-----")) | F.contains(text, F.lit("\0")) | (F.regexp_count(text, F.lit("�")) / n > 0.02), "binary")
        .when(text.rlike(r"\A\s*#!"), "code")
        .when(F.size(lines) == 0, "document")
        .when(F.regexp_count(text, F.lit("[\u3040-\u30ff\u4e00-\u9fff]")) / n > 0.1, "document")
        .when(share(lambda x: x.rlike(r"^\s*[A-Za-z_][A-Za-z0-9_.-]*\s*[:=]\s*\S")) > 0.5, "code")
        .when(F.regexp_count(text, F.lit(r"[{}();<>\[\]]")) / n > 0.02, "code")
        .when(share(lambda x: x.rlike(r"^\s*(#|//|--|\*|/\*)")) > 0.3, "code")
        .otherwise("document")
    )


def non_negative(c: Column, default: int | None = 0) -> Column:
    """Text of a whole number from 0 up as a long; anything else, signs and true or false included, is the default."""
    return F.when(c.rlike(r"\A[0-9]{1,18}\z"), c.try_cast("long")).otherwise(F.lit(default).cast("long"))


def plain_number(c: Column) -> Column:
    """A number as text: without a fraction if it is whole."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


#: Kinds of evidence, the best first.
VIA_ORDER = (
    "bean_class", "mapper_type", "mapper_namespace", "action_class", "config_key", "config_value",
    "cics_xctl", "cics_link",
    "call", "extends", "implements", "inject", "field_type", "include", "import", "copy", "exec_sql",
    "vba_sql", "mapper_sql", "exec_proc", "include_member",
    "write_file", "read_file", "use",
)


def via_rank(c: Column) -> Column:
    """Place in the order of evidence from 0; unknown ones and null come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in VIA_ORDER]), c)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(len(VIA_ORDER)).cast("int")


def column_letters(c: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA; up to three letters, as sheets have."""
    letter = lambda n: F.char(n % 26 + 65)
    two, three = c - 27, c - 703
    return (
        F.when(c <= 26, letter(c - 1))
        .when(c <= 702, F.concat(letter(F.floor(two / 26)), letter(two)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26)), letter(three)))
    )


def column_number(letters: Column) -> Column:
    """The inverse, of upper-case letters."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda s, x: s * 26 + F.ascii(x) - 64)


def narrowed(scopes: Column, prefix: Column) -> Column:
    """Scopes within a folder: (scopes, error). It never widens; a folder outside, absolute or with .. is an error."""
    raw = F.trim(F.coalesce(prefix, F.lit("")))
    inner = F.trim(raw, F.lit("/"))
    below = lambda a, b: (a == b) | F.startswith(a, F.concat(b, F.lit("/")))
    bad = F.startswith(raw, F.lit("/")) | F.contains(raw, F.lit("\\")) | F.array_contains(F.split(inner, "/"), "..") | (inner == "")
    kept = F.filter(scopes, lambda s: F.startswith(s, F.concat(inner, F.lit("/"))))
    state = lambda s, e: F.struct(s.alias("scopes"), F.lit(e).cast("string").alias("error"))
    return (
        F.when(raw == "", state(scopes, None))
        .when(bad, state(scopes, "not a folder"))
        .when((F.size(scopes) == 0) | F.exists(scopes, lambda s: below(inner, s)), state(F.array(inner), None))
        .when(F.size(kept) > 0, state(kept, None))
        .otherwise(state(scopes, "outside"))
    )
