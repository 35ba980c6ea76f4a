"""Files to a graph with flows of data: programs, jobs, books, and other languages."""

import random

import pytest
from pyspark.sql import functions as F

from heronry.operators import build, graph, programs


def cbl(name, select="", fd="", proc="", copy=""):
    return (
        f"       IDENTIFICATION DIVISION.\n       PROGRAM-ID. {name}.\n       ENVIRONMENT DIVISION.\n       INPUT-OUTPUT SECTION.\n       FILE-CONTROL.\n{select}"
        f"       DATA DIVISION.\n       FILE SECTION.\n{fd}       WORKING-STORAGE SECTION.\n{copy}       PROCEDURE DIVISION.\n{proc}           STOP RUN.\n"
    )


def sel(file, dd):
    return f"           SELECT {file} ASSIGN TO UT-S-{dd}.\n"


def fd(file, record):
    return f"       FD  {file}.\n       01  {record} PIC X(80).\n"


READ = cbl("READPG", sel("IN-F", "INDD"), fd("IN-F", "IN-R"), "           OPEN INPUT IN-F.\n")
WRITE = cbl("WRITEPG", sel("OUT-F", "OUTDD"), fd("OUT-F", "OUT-R"), "           OPEN OUTPUT OUT-F.\n")


def made(spark, files):
    return build.world(spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files.items())], "doc_id long, path string, text string"))


def short(cid):
    return cid.split("|", 2)[2] if cid.startswith("dataset") else cid.rsplit("|", 1)[1]


def flows(w):
    return {(short(e.src), short(e.dst), e.via) for e in w.edges.filter("type = 'FLOWS_TO'").collect()}


def flags(w):
    return {(f.path, f.kind, f.name, f.status) for f in w.flags.collect()}


def test_two_programs_by_one_data_set_of_their_folder(spark):
    w = made(spark, {
        "g1/A.cbl": WRITE, "g1/B.cbl": READ, "g1/J1.jcl": "//J1 JOB\n//S EXEC PGM=WRITEPG\n//OUTDD DD DSN=PROD.CALC(+1),\n//* note\n//   DISP=(NEW,CATLG)\n",
        "g1/J2.jcl": "//J2 JOB\n//S EXEC PGM=READPG\n//INDD DD DSN='PROD.CALC(0)',DISP=SHR\n",
        "g2/B.cbl": READ, "g2/J.jcl": "//J JOB\n//S EXEC PGM=READPG\n//INDD DD DSN=PROD.CALC,DISP=SHR\n",
    })
    rows = {(e.src, e.dst, e.via, tuple(e.lines)) for e in w.edges.filter("type = 'FLOWS_TO'").collect()}
    one, two = "dataset|g1|PROD.CALC", "dataset|g2|PROD.CALC"
    assert {r[:3] for r in rows} == {("program|g1/A.cbl|WRITEPG", one, "write_file"), (one, "program|g1/B.cbl|READPG", "read_file"), (two, "program|g2/B.cbl|READPG", "read_file")}
    assert {(n.cid, n.path) for n in w.nodes.filter("kind = 'dataset'").collect()} == {(one, "g1/J1.jcl"), (two, "g2/J.jcl")}
    assert {(m.dataset, m.path) for m in w.membership.collect()} == {(one, "g1/J1.jcl"), (one, "g1/J2.jcl"), (two, "g2/J.jcl")}


def test_many_jobs_of_a_data_set_are_all_members_and_places_are_cut(spark):
    paths = [f"g/p{i:02}/J.jcl" for i in range(22)]
    files = {p: "//J JOB\n//S EXEC PGM=READPG\n//INDD DD DSN=DEMO.SHARED,DISP=SHR\n" for p in paths} | {"g/R.cbl": READ}
    d = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files.items())], "doc_id long, path string, text string")
    _, sets, members, _ = build.flows(build.resolve(d))
    r = sets.first()
    assert sorted(m.path for m in members.collect()) == paths and len(r.places) == 20 and r.overflow == 2 and not r.generations


def test_unbound_names_are_reported(spark):
    w = made(spark, {"g/A.cbl": WRITE})
    assert ("g/A.cbl", "dataset", "OUTDD", "unresolved") in flags(w) and not flows(w)


def test_temporary_data_sets_stay_in_their_job(spark):
    w = made(spark, {
        "g/W.cbl": WRITE, "g/R.cbl": READ,
        "g/ONE.jcl": "//ONE JOB\n//S1 EXEC PGM=WRITEPG\n//OUTDD DD DSN=&&WORK,DISP=(NEW,PASS)\n//S2 EXEC PGM=READPG\n//INDD DD DSN=&&WORK\n",
        "g/TWO.jcl": "//TWO JOB\n//S1 EXEC PGM=READPG\n//INDD DD DSN=&&WORK\n",
    })
    assert flows(w) == {("WRITEPG", "g/ONE.jcl:&&WORK", "write_file"), ("g/ONE.jcl:&&WORK", "READPG", "read_file"), ("g/TWO.jcl:&&WORK", "READPG", "read_file")}


def test_concatenated_definitions_and_several_jobs(spark):
    w = made(spark, {"g/R.cbl": READ, "g/A.jcl": "//A JOB\n//S EXEC PGM=READPG\n//INDD DD DSN=PROD.ONE,DISP=SHR\n//   DD DSN=PROD.TWO\n", "g/B.jcl": "//B JOB\n//S EXEC PGM=READPG\n//INDD DD DSN=PROD.THREE\n"})
    assert flows(w) == {(d, "READPG", "read_file") for d in ("PROD.ONE", "PROD.TWO", "PROD.THREE")}


def test_both_directions_and_statements_without_open(spark):
    w = made(spark, {
        "g/U.cbl": cbl("UPD", sel("MST", "MASTER") + sel("LOG-F", "LOGDD") + sel("S", "SRT"), fd("MST", "M-R") + fd("LOG-F", "LOG-R") + "       SD  S.\n", "           OPEN I-O WITH NO REWIND MST.\n           WRITE LOG-R.\n           SORT S.\n"),
        "g/J.jcl": "//J JOB\n//S EXEC PGM=UPD\n//MASTER DD DSN=P.MST\n//LOGDD DD DSN=P.LOG\n",
    })
    assert flows(w) == {("UPD", "P.MST", "write_file"), ("P.MST", "UPD", "read_file"), ("UPD", "P.LOG", "write_file")}


def test_forms_that_make_no_data_set(spark):
    w = made(spark, {"g/R.cbl": READ, "g/J.jcl": "//J JOB\n//S EXEC PGM=READPG\n//INDD DD DSN=&HLQ..DATA\n//S2 EXEC PGM=SORT\n//SORTIN DD DSN=PROD.X\n//S3 EXEC PGM=NOSUCH\n//INDD DD DSN=PROD.Y\n"})
    assert not flows(w) and {("g/R.cbl", "dataset", "INDD", "unresolved"), ("g/J.jcl", "program", "NOSUCH", "unresolved")} <= flags(w)
    notes = programs.facts(spark.createDataFrame([(1, "g/J.jcl", "//S EXEC PGM=A\n//X DD DSN=*.NO.DD\n//S.Y DD DSN=B\n//Z DD DSN=&A..B\n//S2 EXEC PGM=IDCAMS\n//S3 EXEC PGM=&P")], "doc_id long, path string, text string")).filter("role = 'note'")
    assert {r.kind for r in notes.collect()} == {"dsn_backref_unresolved", "dd_override", "dsn_symbolic", "utility_step", "symbolic"}


def test_items_of_copied_books(spark):
    w = made(spark, {
        "g/OUTER.cpy": "       COPY INNER.\n       01  OUTER-ITEM PIC X.\n", "g/INNER.cpy": "       COPY OUTER.\n       01  INNER-ITEM PIC X.\n       01  DUP-ITEM PIC X.\n",
        "g/OTHER.cpy": "       01  DUP-ITEM PIC X.\n       01  OTHER-ITEM PIC X.\n",
        "g/PGA.cbl": cbl("PGA", proc="           MOVE INNER-ITEM TO OUTER-ITEM.\n           MOVE DUP-ITEM TO OTHER-ITEM.\n", copy="           COPY OUTER.\n           COPY OTHER.\n"),
        "g/PGB.cbl": cbl("PGB", proc="           MOVE INNER-ITEM TO WS-X.\n"),
    })
    assert flows(w) == {(i, "PGA", "use") for i in ("INNER-ITEM", "OUTER-ITEM", "OTHER-ITEM")}
    assert {f for f in flags(w) if f[3] == "use_ambiguous"} == {("g/PGA.cbl", "item", "DUP-ITEM", "use_ambiguous")}


def test_owner_is_the_first_definition_by_line(spark):
    w = made(spark, {"g/A.cbl": "       PROGRAM-ID. ZZZ.\n           CALL 'Q'.\n       PROGRAM-ID. AAA.\n           CALL 'ZZZ'.\n", "g/Q.cbl": "       PROGRAM-ID. Q.\n"})
    assert {(short(e.src), short(e.dst)) for e in w.edges.collect()} == {("ZZZ", "Q"), ("ZZZ", "ZZZ")}


def test_edges_of_other_languages(spark):
    w = made(spark, {
        "a/K.java": "package p;\n@Service(\"svc\")\npublic class K\n   extends Base\n   implements I1 {\n  // new Not()\n  public int run(int a) { return new T1(a); }\n  @Value(\"${db.url}\") String u;\n}\n", "a/Base.java": "class Base { }\n", "a/I.java": "interface I1 { }\n", "a/T.java": "class T1 { }\n",
        "a/ctx.xml": "<beans><bean id=\"b1\"\n   class=\"p.K\"><property ref=\"svc\"/></bean></beans>", "a/app.properties": "# c\ndb.url = x\n", "a/y.yml": "db:\n  user: me\n",
        "a/m.c": "#include \"lib/h.h\"\nint h(int a);\nstatic int\ng(int a)\n{\n  if (a) return f(a) + h(a);\n}\n", "a/lib/h.h": "int f(int a);\n", "a/lib/f.c": "int f(int a) {\n return 1;\n}\nint h(int a) {\n return 2;\n}\n",
        "a/q.sql": "CREATE TABLE s.t1 (id INT);\nINSERT INTO t2 SELECT * FROM s.t1;\n", "a/t2.sql": "CREATE TABLE t2 (id INT);\n", "a/P.cbl": cbl("P", proc="           EXEC SQL SELECT A INTO :B FROM T2X\n              END-EXEC.\n           EXEC CICS LINK PROGRAM('Q') END-EXEC.\n"), "a/Q.cbl": cbl("Q"),
        "a/p.html": "<script src='js/s.js'></script>\n<!-- <a href='no.html'> -->", "a/js/s.js": "import x from './t.js'\nfunction go() {}\n", "a/js/t.js": "", "a/M.vb": "Public Class M\n Inherits Base2\nEnd Class\n", "a/r.sh": "#!/bin/sh\n# sh no.sh\n. ./env.sh\n", "a/env.sh": "A=1\n",
    })
    got = {(short(e.src), e.type, e.dst.split("|")[0], short(e.dst)) for e in w.edges.collect()}
    want = {("K", "EXTENDS", "type", "Base"), ("K", "IMPLEMENTS", "type", "I1"), ("K", "USES", "type", "T1"), ("K", "READS", "config", "db.url"), ("b1", "USES", "type", "K"), ("m.c", "INCLUDES", "file", "h.h"), ("g", "CALLS", "function", "f"), ("g", "CALLS", "function", "h"),
            ("t1", "READS", "table", "t1"), ("t1", "WRITES", "table", "t2"), ("P", "INVOKES", "program", "Q"), ("p.html", "INCLUDES", "file", "s.js"), ("s.js", "IMPORTS", "file", "t.js"), ("r.sh", "INCLUDES", "file", "env.sh"), ("b1", "INJECTS", "bean", "svc")}
    assert got == want, (got - want, want - got)
    ends = {(short(e.src), e.dst) for e in w.edges.filter("type = 'CALLS'").collect()}
    assert ends == {("g", "function|a/lib/f.c|f"), ("g", "function|a/lib/f.c|h")}  # definitions before declarations, even nearer ones
    assert ("a/M.vb", "type", "Base2", "unresolved") in flags(w) and ("a/P.cbl", "table", "T2X", "unresolved") in flags(w)


@pytest.mark.parametrize("edges, want", [
    ([(1, 2), (2, 3), (3, 1), (4, 1)], {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3)}),
    ([(1, 2), (1, 2), (2, 4), (1, 3), (3, 4), (4, 5), (6, 6)], {(1, 2), (1, 3), (1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5), (6, 6)}), ([], set()),
])
def test_reach(spark, edges, want):
    e = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(map(tuple, graph.reach(e).collect())) == sorted(want)
    some = spark.createDataFrame([(1,), (9,)], "id long")
    assert set(map(tuple, graph.reach(e, some).collect())) == {p for p in want if p[0] == 1}


@pytest.mark.parametrize("small", [0, 100_000])
def test_starts_of_a_node_share_a_row(spark, small):
    rng = random.Random(small)
    pairs = [(k // 2, k) for k in range(300)] + [(rng.randint(0, 299), rng.randint(0, 299)) for _ in range(20)] + [(7, 7), (400, 401), (401, 400)]
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)
    want = set()
    for first in [*range(0, 300, 3), 401]:
        front = {first}
        while front := {b for a in front for b in below.get(a, ())} - {b for a, b in want if a == first}:
            want |= {(first, b) for b in front}
    e, starts = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(a,) for a in [*range(0, 300, 3), 401, 900]], "id long")
    numbers = graph.numbered(starts)
    rows = graph.reached(e, numbers, small)
    assert sorted(map(tuple, graph.marked(spark.createDataFrame(sorted(want), "start long, id long"), numbers).collect())) == sorted(map(tuple, rows.collect()))
    assert rows.count() < len(want) and set(map(tuple, graph.reach(e, starts).collect())) == want
    got = build.quality(rows, graph.marked(spark.createDataFrame(sorted(want)[::2], "start long, id long"), numbers)).first()
    assert (got.recall, got.precision) == (1.0, round(len(sorted(want)[::2]) / len(want), 6))
    assert tuple(build.quality(rows.limit(0), rows.limit(0)).first()) == (1.0, 1.0)


def test_an_answer_is_cut_only_if_asked(spark):
    nodes = spark.range(10_003).selectExpr("'n' || id AS cid", "'program' AS kind", "'N' || id AS name", "'a/n' || id AS path", "'a' AS top")
    edges = spark.range(1, 10_003).selectExpr("'n' || id AS src", "'CALLS' AS type", "if(id = 10002, 'n1', 'n0') AS dst")
    whole, limits = build.answer(nodes, edges, "N0", 1)
    assert whole.count() == 10_002 and list(map(tuple, limits.collect())) == [("depth", "impact", None)]
    cut, limits = build.answer(nodes, edges, "N0", 5, ceiling=10_000)
    assert cut.count() == 10_001 and list(map(tuple, limits.collect())) == [("row_cap", "impact", 10_000)]


def test_facts_are_parsed_once(spark):
    d = spark.createDataFrame([(1, "g/A.cbl", READ), (2, None, READ), (3, "g/x", None)], "doc_id long, path string, text string")
    edges = build.build(d)[1]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan
    assert build.world(d.limit(0)).edges.filter(F.lit(True)).collect() == []
