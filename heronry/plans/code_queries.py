"""Queries that parse program texts made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import code
from heronry.plans.base import Registry
from heronry.plans.parser_queries import made, rows

query = Registry()
NL = " || chr(10) || "
JAVA = NL.join(["'package a.b' || (o_custkey % 9) || ';'", "'import c.T' || o_custkey || '; // import no.No;'", "'/* class Not {'", "' import x.Y; */ @Service(\"s' || o_orderkey || '\")'", "'public class K' || o_orderkey || ' extends B' || (o_custkey % 4) || ' {'", "'  public int run(int a) { return new T' || o_custkey || '(); }'"])
C_TEXT = NL.join(["'#include <h' || (o_custkey % 9) || '.h>'", "'struct s' || o_custkey || ' {'", "'int f' || o_orderkey || '(int a) {'"])
CS_TEXT = NL.join(["'using S.T' || o_custkey || ';'", "'namespace N' || (o_custkey % 5) || ' {'", "'class K' || o_orderkey || ' : B {'"])
VB_TEXT = NL.join(["'Imports S.T' || o_custkey", "'Public Class K' || o_orderkey", "' Inherits B'", "'Private Sub M' || (o_custkey % 5) || '() '' Call No'"])
WEB = NL.join(["'<script src=\"s' || o_custkey || '.js\">'", "'function f' || o_orderkey || '() {}'", "'import x from \"./m' || (o_custkey % 7) || '\"'"])
XML_TEXT = NL.join(["'<bean id=\"b' || o_orderkey || '\" class=\"c.C' || o_custkey || '\">'", "'<property ref=\"r' || (o_custkey % 3) || '\"/>'"])
DDL = NL.join(["'CREATE TABLE a.t' || o_orderkey || ' ( -- one'", "'  id NUMERIC(10, 2), c' || (o_custkey % 5) || ' INT DEFAULT f(1, 2),'", "'  PRIMARY KEY (id) );'", "'INSERT INTO w' || o_custkey || ' SELECT * FROM r' || (o_custkey % 8) || ' JOIN q ON 1 = 1'"])
COPY = NL.join(["'       01 REC' || o_orderkey || '.'", "'         05 GRP.'", "'           10 A PIC 9 VALUE ' || (o_custkey % 10) || '.'", "'           88 YES VALUE 1.'", "'         05 FILLER.'", "'           10 B' || (o_custkey % 4) || ' PIC X.'"])
YAML = NL.join(["'a:'", "'  b: ' || o_orderkey", "'  # c: no'", "'  d:'", "'    e: x' || o_custkey || ' # note'", "'f: \"' || o_orderstatus || '\"'"])
CBL = NL.join(["'000100 MOVE A' || (o_custkey % 3) || ' TO B C.'", "'000200* MOVE X TO Y.'", "'000300 EXEC SQL SELECT Q FROM T' || o_custkey", "'000400   WHERE K = 1 END-EXEC.'", "'000500 COMPUTE D = B + 1.'", "'000600 DISPLAY \"AB'", "'000700-    \"CD\".'"])
TABLE = NL.join(["'Body ' || o_orderkey", "''", "'more'", "'| a |'", "'| b' || o_custkey || ' |'", "'| c |'"])


@query("java_references", rows(
    "1 AS line, 'package' AS kind, 'a.b' || (o_custkey % 9) AS name", "2, 'import', 'c.T' || o_custkey", "4, 'component', 's' || o_orderkey", "5, 'type', 'K' || o_orderkey",
    "5, 'extends', 'B' || (o_custkey % 4)", "6, 'method', 'run'", "6, 'new', 'T' || o_custkey",
))
def java_references(spark, sf_dir):  # P06, P07, P15
    return code.scan(code.code_lines(made(spark, sf_dir, JAVA)), code.JAVA + code.SPRING)


@query("c_references", rows("1 AS line, 'include' AS kind, 'h' || (o_custkey % 9) || '.h' AS name", "2, 'type', 's' || o_custkey", "3, 'function', 'f' || o_orderkey"))
def c_references(spark, sf_dir):  # P08
    return code.scan(code.code_lines(made(spark, sf_dir, C_TEXT)), code.C)


@query("csharp_references", rows("1 AS line, 'import' AS kind, 'S.T' || o_custkey AS name", "2, 'namespace', 'N' || (o_custkey % 5)", "3, 'type', 'K' || o_orderkey", "3, 'extends', 'B'"))
def csharp_references(spark, sf_dir):  # P08
    return code.scan(code.code_lines(made(spark, sf_dir, CS_TEXT)), code.CSHARP)


@query("vb_references", rows("1 AS line, 'import' AS kind, 'S.T' || o_custkey AS name", "2, 'type', 'K' || o_orderkey", "3, 'extends', 'B'", "4, 'method', 'M' || (o_custkey % 5)"))
def vb_references(spark, sf_dir):  # P09
    return code.scan(code.code_lines(made(spark, sf_dir, VB_TEXT), "'"), code.VB)


@query("web_references", rows("1 AS line, 'script' AS kind, 's' || o_custkey || '.js' AS name", "2, 'function', 'f' || o_orderkey", "3, 'import', './m' || (o_custkey % 7)"))
def web_references(spark, sf_dir):  # P10
    return code.scan(code.code_lines(made(spark, sf_dir, WEB)), code.SCRIPT)


@query("xml_references", rows("1 AS line, 'bean' AS kind, 'b' || o_orderkey AS name", "1, 'class', 'c.C' || o_custkey", "2, 'ref', 'r' || (o_custkey % 3)"))
def xml_references(spark, sf_dir):  # P12
    return code.scan(code.code_lines(made(spark, sf_dir, XML_TEXT), None), code.XML)


@query("sql_references", rows("1 AS line, 'table' AS kind, 'a.t' || o_orderkey AS name", "4, 'write', 'w' || o_custkey", "4, 'read', 'r' || (o_custkey % 8)", "4, 'read', 'q'"))
def sql_references(spark, sf_dir):  # P05
    return code.scan(code.code_lines(made(spark, sf_dir, DDL), "--"), code.SQL)


@query("sql_columns", rows("'a.t' || o_orderkey AS \"table\", 1 AS nth, 'id' AS \"column\"", "'a.t' || o_orderkey, 2, 'c' || (o_custkey % 5)"))
def sql_columns(spark, sf_dir):  # P05
    return code.table_columns(made(spark, sf_dir, DDL))


@query("analyzers_by_extension", "SELECT o_orderkey AS doc_id, 1 AS line, 'include' AS kind, 'h' || (o_custkey % 9) || '.h' AS name, 'c' AS analyzer FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 2, 'type', 's' || o_custkey, 'c' FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 3, 'function', 'f' || o_orderkey, 'c' FROM orders WHERE o_orderkey % 2 = 0")
def analyzers_by_extension(spark, sf_dir):  # P14
    path = F.concat(F.lit("a/f"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".c").otherwise(".txt"))
    return code.analyze(made(spark, sf_dir, C_TEXT).withColumn("path", path))


@query("copybook_items", rows(
    "1 AS line, 1 AS level, 'REC' || o_orderkey AS name, 'REC' || o_orderkey AS key, NULL AS value", "2, 5, 'GRP', 'REC' || o_orderkey || '.GRP', NULL",
    "3, 10, 'A', 'REC' || o_orderkey || '.GRP.A', (o_custkey % 10)::VARCHAR", "6, 10, 'B' || (o_custkey % 4), 'REC' || o_orderkey || '.B' || (o_custkey % 4), NULL",
))
def copybook_items(spark, sf_dir):  # P03
    return code.copybook(made(spark, sf_dir, COPY))


@query("yaml_keys", rows("2 AS line, 'a.b' AS key, o_orderkey::VARCHAR AS value", "5, 'a.d.e', 'x' || o_custkey", "6, 'f', o_orderstatus"))
def yaml_keys(spark, sf_dir):  # P13
    return code.yaml_keys(made(spark, sf_dir, YAML))


@query("cobol_logical_lines", rows("6 AS line, 'DISPLAY \"ABCD\".' AS txt"))
def cobol_logical_lines(spark, sf_dir):  # P02
    return code.cobol_lines(made(spark, sf_dir, CBL)).filter("txt LIKE '%DISPLAY%'")


@query("exec_blocks", rows("1 AS nth, 'SQL' AS kind, 'SELECT Q FROM T' || o_custkey || ' WHERE K = 1' AS body"))
def exec_blocks(spark, sf_dir):  # P01
    return code.exec_blocks(made(spark, sf_dir, CBL))


@query("item_flow", rows("1 AS line, 'A' || (o_custkey % 3) AS src, 'B' AS dst", "1, 'A' || (o_custkey % 3), 'C'", "5, 'B', 'D'"))
def item_flow(spark, sf_dir):  # M28
    return code.data_flow(made(spark, sf_dir, CBL))


@query("row_groups", rows("1 AS \"first\", 3 AS \"last\", 'body' AS kind, (5 + len(o_orderkey::VARCHAR) + 4)::BIGINT AS bytes", "4, 5, 'row', (5 + 5 + len(o_custkey::VARCHAR))::BIGINT", "6, 6, 'row', 5"))
def row_groups(spark, sf_dir):  # X16
    return code.row_groups(made(spark, sf_dir, TABLE), rows=2)
