"""Queries that parse job control, configuration and COBOL texts made of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import parsers
from heronry.plans.base import Registry
from heronry.session import table

query = Registry()
#: A text for each order, from its keys; the same expression in Spark and in DuckDB.
JCL = "'//J' || o_orderkey || ' JOB 1' || chr(10) || '//* //X EXEC PGM=NO' || chr(10) || '//S1 EXEC PGM=P' || o_custkey || ',REGION=1M' || chr(10) || '//IN DD DSN=A.D' || (o_custkey % 50) || '(0),DISP=SHR' || chr(10) || '//S2 EXEC PROC=R' || (o_orderkey % 9) || chr(10) || '//X DD DSN=SKIP.ME' || chr(10) || '//S3 EXEC PGM=&WHICH' || chr(10) || '//B DD DSN=*.S1.IN'"
PROPS = "'# made = up' || chr(10) || 'order.id=' || o_orderkey || chr(10) || '  customer.id : c' || o_custkey || ' ' || chr(10) || chr(10) || 'state=' || o_orderstatus || '=x'"
SHELL = "'#!/bin/sh' || chr(10) || 'export K=' || o_orderkey || chr(10) || '. ./env' || (o_custkey % 5) || '.sh' || chr(10) || 'ksh run' || o_custkey || '.ksh -v' || chr(10) || '# sh no.sh'"
COBOL = "'       COPY BEFORE.' || chr(10) || '       PROGRAM-ID. P' || o_orderkey || '.' || chr(10) || '      * COPY COMMENT.' || chr(10) || '           SELECT F' || (o_custkey % 7) || ' ASSIGN TO X.' || chr(10) || '       copy c' || (o_custkey % 30) || '.' || chr(10) || '           CALL \"' || 'M' || o_custkey || '\".' || chr(10) || '           CALL WS-NAME.'"


def made(spark, sf_dir, text):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(text.replace("chr(10)", "'\\n'").replace("\\\"", '"')).alias("text"))


def rows(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, {p} FROM orders" for p in parts)


@query("jcl_references", rows(
    "1 AS line, 'job' AS kind, 'J' || o_orderkey AS name, 'ok' AS status", "3, 'module', 'P' || o_custkey, 'ok'",
    "5, 'exec_proc', 'R' || (o_orderkey % 9), 'ok'", "7, 'module', '&WHICH', 'symbolic'",
))
def jcl_references(spark, sf_dir):  # P04
    return parsers.jcl(made(spark, sf_dir, JCL))


@query("dd_bindings", rows(
    "4 AS line, 'S1' AS step, 'P' || o_custkey AS program, 'IN' AS dd, 'A.D' || (o_custkey % 50) AS dataset, '0' AS generation",
    "8, 'S3', '&WHICH', 'B', 'A.D' || (o_custkey % 50), '0'",
))
def dd_bindings(spark, sf_dir):  # P04, J11
    return parsers.dd_bindings(made(spark, sf_dir, JCL))


@query("properties_keys", rows("2 AS line, 'order.id' AS key, o_orderkey::VARCHAR AS value", "3, 'customer.id', 'c' || o_custkey", "5, 'state', o_orderstatus || '=x'"))
def properties_keys(spark, sf_dir):  # P13
    return parsers.properties(made(spark, sf_dir, PROPS))


@query("shell_references", rows("2 AS line, 'assign' AS kind, 'K' AS name", "3, 'source', './env' || (o_custkey % 5) || '.sh'", "4, 'call', 'run' || o_custkey || '.ksh'"))
def shell_references(spark, sf_dir):  # P11
    return parsers.shell(made(spark, sf_dir, SHELL))


@query("cobol_references", rows(
    "2 AS line, 'program' AS kind, 'P' || o_orderkey AS name", "4, 'file', 'F' || (o_custkey % 7)", "5, 'copy', 'C' || (o_custkey % 30)",
    "6, 'call', 'M' || o_custkey", "7, 'dynamic_call', 'WS-NAME'",
))
def cobol_references(spark, sf_dir):  # P01
    return parsers.cobol(made(spark, sf_dir, COBOL))
