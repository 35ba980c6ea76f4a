"""Definitions and references in job control, configuration and COBOL texts.

All work line by line inside Spark: a line's meaning comes from regular expressions,
and what a line owes to earlier ones from a window over its own file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.operators.text import lines


def _part(pattern: str, column: str = "txt"):
    return F.regexp_extract(column, pattern, 1)


def jcl(docs: DataFrame) -> DataFrame:
    """(doc_id, line, kind, name, status) of job-control statements.

    Kinds: job and proc are definitions; module (EXEC PGM), exec_proc and include are
    references. Names with ``&`` are dropped as symbolic; comments are skipped.
    """
    s = lines(docs, "doc_id").filter(F.col("txt").rlike(r"^//[^*]"))
    s = s.select("doc_id", "line", _part(r"^//(\S*)").alias("label"), _part(r"^//\S*\s+(\S+)").alias("op"), _part(r"^//\S*\s+\S+\s+(\S+)").alias("args"))
    pgm, member = _part(r"(?:^|,)PGM=([^,\s]+)", "args"), _part(r"MEMBER=\(?([^,)\s]+)", "args")
    name = (
        F.when(F.col("op").isin("JOB", "PROC"), F.col("label"))
        .when((F.col("op") == "EXEC") & (pgm != ""), pgm)
        .when(F.col("op") == "EXEC", F.regexp_replace(_part(r"^([^,\s]+)", "args"), "^PROC=", ""))
        .when(F.col("op") == "INCLUDE", member)
    )
    kind = F.when(F.col("op") == "JOB", "job").when(F.col("op") == "PROC", "proc").when(F.col("op") == "INCLUDE", "include").when(pgm != "", "module").otherwise("exec_proc")
    status = F.when(F.contains("name", F.lit("&")), "symbolic").otherwise("ok")
    return s.select("doc_id", "line", kind.alias("kind"), name.alias("name")).filter("name <> ''").withColumn("status", status)


def dd_bindings(docs: DataFrame, utilities: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line, step, program, dd, dataset, generation) of DD statements below EXEC PGM.

    A dataset's relative generation is split off; ``*.step.dd`` takes the dataset of that
    earlier statement; steps that run a procedure or a utility are skipped.
    """
    s = lines(docs, "doc_id").filter(F.col("txt").rlike(r"^//[^*]"))
    op, label = _part(r"^//\S*\s+(\S+)"), _part(r"^//(\S*)")
    step = F.when(op == "EXEC", F.struct(label.alias("step"), F.nullif(_part(r"PGM=([^,\s]+)"), F.lit("")).alias("program")))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("doc_id", "line", op.alias("op"), label.alias("dd"), _part(r"DSN(?:AME)?=([^,\s]+)").alias("dsn"), F.last(step, True).over(upto).alias("at"))
    d = s.filter((F.col("op") == "DD") & (F.col("dsn") != "") & F.col("at.program").isNotNull() & ~F.col("at.program").isin(*utilities))
    d = d.select("doc_id", "line", "at.step", "at.program", "dd", "dsn")
    back = d.filter(~F.startswith("dsn", F.lit("*."))).groupBy("doc_id", F.concat(F.lit("*."), "step", F.lit("."), "dd").alias("dsn")).agg(F.min_by("dsn", "line").alias("real"))
    d = d.join(back, ["doc_id", "dsn"], "left").withColumn("real", F.coalesce("real", "dsn"))
    generation = F.nullif(_part(r"\(([+-]?[0-9]+)\)$", "real"), F.lit(""))
    return d.select("doc_id", "line", "step", "program", "dd", F.regexp_replace("real", r"\([+-]?[0-9]+\)$", "").alias("dataset"), generation.alias("generation"))


def properties(docs: DataFrame) -> DataFrame:
    """(doc_id, line, key, value) of ``key=value`` or ``key: value`` lines; comments are skipped."""
    pattern = r"^\s*([^#!=:\s][^=:\s]*)\s*[=:]\s*(.*?)\s*$"
    hit = lines(docs, "doc_id").filter(F.col("txt").rlike(pattern))
    return hit.select("doc_id", "line", F.regexp_extract("txt", pattern, 1).alias("key"), F.regexp_extract("txt", pattern, 2).alias("value"))


def shell(docs: DataFrame) -> DataFrame:
    """(doc_id, line, kind, name): assignments, and scripts that are run or sourced."""
    s = lines(docs, "doc_id").filter(~F.col("txt").rlike(r"^\s*#"))
    kinds = F.array(
        F.struct(F.lit("assign").alias("kind"), _part(r"^\s*(?:export\s+)?([A-Za-z_]\w*)=").alias("name")),
        F.struct(F.lit("source").alias("kind"), _part(r"^\s*(?:\.|source)\s+(\S+)").alias("name")),
        F.struct(F.lit("call").alias("kind"), _part(r"^\s*(?:(?:ba|k)?sh\s+)?(\S+\.(?:k?sh|bash))(?:\s|$)").alias("name")),
    )
    return s.select("doc_id", "line", F.inline(F.filter(kinds, lambda k: k["name"] != "")))


def cobol(docs: DataFrame) -> DataFrame:
    """(doc_id, line, kind, name): the program, and after it copies, calls and files.

    Calls of a name in quotes are ``call``, of a data item ``dynamic_call``. A ``*`` in
    column 7 or first in the line makes a comment.
    """
    s = lines(docs, "doc_id").filter(~F.col("txt").rlike(r"^(?:.{6}\*|\s*\*)"))
    up = s.withColumn("txt", F.upper("txt"))
    one = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), _part(pattern).alias("name"))
    kinds = F.array(
        one("program", r"\bPROGRAM-ID\s*\.\s*[\"']?([A-Z0-9][A-Z0-9-]*)"),
        one("copy", r"\bCOPY\s+[\"']?([A-Z0-9][A-Z0-9-]*)"),
        one("call", r"\bCALL\s+[\"']([^\"']+)[\"']"),
        one("dynamic_call", r"\bCALL\s+([A-Z0-9][A-Z0-9-]*)"),
        one("file", r"\bSELECT\s+(?:OPTIONAL\s+)?([A-Z0-9][A-Z0-9-]*)\s+ASSIGN\b"),
    )
    found = up.select("doc_id", "line", F.inline(F.filter(kinds, lambda k: k["name"] != "")))
    begin = F.min(F.when(F.col("kind") == "program", F.col("line"))).over(Window.partitionBy("doc_id"))
    return found.withColumn("begin", begin).filter("line >= begin").drop("begin")
