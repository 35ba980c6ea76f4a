"""Registration of queries with their oracles, and shared inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.session import table

#: A tree of files made of documents, as SQL; FILE_EXT in the order of doc_id mod 8.
FILE_EXT = ("md", "py", "cbl", "sql", "bak", "pem", "txt", "bin")
FILES_SQL = f"""files AS (SELECT doc_id, source || '/' || lang || '/d' || (doc_id % 5) || '/f' || doc_id || '.' || [{", ".join(repr(e) for e in FILE_EXT)}][(doc_id % 8 + 1)::INT] AS path, text FROM documents)"""


def files(spark, sf_dir):
    """The same as a DataFrame."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in FILE_EXT]), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id") % 5, F.lit("/f"), "doc_id", F.lit("."), ext)
    return d.select("doc_id", path.alias("path"), "text")


class Registry:
    """Queries and oracles of one module."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(f):
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return add
