from heronry.llm import op9_license as op

ROWS = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (2, "a/b/x.py", "print(1)"),
    (3, "a/b/c/LICENSE.txt", "Released under the MIT License.\n" + "more words here " * 20),
    (4, "a/b/c/d/y.py", "def f(): pass"),
    (5, "a/z.py", "# SPDX-License-Identifier: GPL-3.0-only\n" + "code()\n" * 20),
    (6, "q/w.py", None),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, "ab/x.py", ""),
    (9, "top.txt", "the word license alone says nothing about terms and " * 3000),
    (2, "a/b/x.py", "print(1)"),
]


def test_scan_and_inheritance(spark):
    d = spark.createDataFrame([(*r, "o") for r in ROWS], "doc_id long, path string, text string, own string")
    got = {r.doc_id: r for r in op.license_scan(d).collect()}
    assert op.license_scan(d).count() == 10
    assert {i: r.licenses for i, r in got.items()} == {1: ["Apache-2.0"], 2: ["Apache-2.0"], 3: ["MIT"], 4: ["MIT"], 5: ["GPL-3.0"], 6: None, 7: ["CC-BY-NC-4.0"], 8: None, 9: None}
    assert got[5].own == ["GPL-3.0"] and got[5].inherited is None and got[2].inherited == ["Apache-2.0"]
    assert op.license_scan(d.limit(0)).collect() == []


def test_every_template_finds_itself():
    t = op.Templates()
    for name, lines in op.TEMPLATES.items():
        for line in lines:
            cosine, best = t.best(line)
            assert best == name and cosine > 0.999
    s = "Für é\nReleased under the MIT License.\n"
    assert [x[:3] for x in op.scan(s, t)] == [(6, 37, "MIT")]


def names(text):
    return [x[2] for x in op.scan(text, op.Templates())]


def test_statements_with_prose_around_them_on_short_lines():
    assert names("Released under the MIT License. See the file for more details of this project") == ["MIT"]
    assert names("Copyright 2020 Foo Corporation, all rights reserved. Released under the MIT License.") == ["MIT"]
    assert names("it under the terms of the GNU General Public License as published by") == ["GPL"]
    for n in (1, 5, 20, 200):
        assert names("plain words " * n + "licensed under the Apache License, Version 2.0 " + "more words " * n) == ["Apache-2.0"]
    header = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\nx = 1\n"
    for name, long, v in (("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-2.1", "Lesser General Public License", 2.1), ("AGPL-3.0", "Affero General Public License", 3)):
        assert names(header.format(long, v)) == [name]
    assert names("he got permission for the MIT course and a driving license in 1990, version 2") == []


def test_variants_versions_and_whole_licences():
    for text, want in {
        "SPDX-License-Identifier: GPL-2.0-only": ["GPL-2.0"], "// SPDX-License-Identifier: ISC": ["ISC"], "/* SPDX-License-Identifier: CC0-1.0 */": ["CC0-1.0"],
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-2-Clause": ["MIT", "Apache-2.0", "BSD-2-Clause"],
        "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": ["GPL-2.0"],
        "GNU Affero General Public License version 3": ["AGPL-3.0"], "Licensed under the BSD 2-Clause License": ["BSD-2-Clause"], "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"], "Eclipse Public License 2.0": ["EPL-2.0"], "under GPLv3.": ["GPL-3.0"], "LGPL v2.1": ["LGPL-2.1"], "the GNU GPL, version 2": ["GPL-2.0"],
    }.items():
        assert names(text) == want, text
    for f in op.TEXTS.glob("*.txt"):
        text = "Copyright (c) 2021 Some Body\n\n" + f.read_text()
        assert op.scan(text, op.Templates())[0][:3] == (0, len(text), f.stem)
    three = (op.TEXTS / "BSD-3-Clause.txt").read_text()
    two = three[: three.index("3. Neither")] + three[three.index("THIS SOFTWARE") :]
    assert names(two) == ["BSD-2-Clause"]


def slow_scan(text, t):
    """Every window of every template over all words, by plain counts; no cue words."""
    got = op.words(text)
    plain = [w for w, *_ in got]
    rows = []
    for name, v, n, need, order in t.slide:
        for a in range(len(plain) - n + 1):
            part = plain[a : a + n]
            c = {w: part.count(w) * t.idf.get(w, t.other) for w in set(part)}
            norm = sum(x * x for x in c.values()) ** 0.5
            cosine = sum(x * v.get(w, 0.0) for w, x in c.items()) / norm
            others = op.marks(part) - op._LOOSE - need
            if n > 8 and not any(op._NUMBER.match(w) for w in need):
                others = {w for w in others if not op._NUMBER.match(w)}
            if cosine >= op.LEAST and need <= set(part) and not others:
                rows.append((round(n * cosine, 6), part == order, -a, a + n, name))
    taken, out = [], []
    for *_, first, last, name in sorted(rows, reverse=True):
        a, b = got[-first][1], got[last - 1][2]
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            out.append((a, name))
    return sorted(out)


def test_windows_equal_plain_cosines_of_all_windows():
    import random

    rng, t = random.Random(9), op.Templates()
    t.texts = []
    prose = "the code of this project may be used by all who read the file and its success is not by chance".split()
    lines = [(name, x) for name, xs in sorted(op.TEMPLATES.items()) for x in xs]
    for _ in range(60):
        some = rng.sample(lines, 3)
        text = " ".join(w for _, x in some for w in [*rng.choices(prose, k=rng.randint(0, 12)), x.upper() if rng.random() < 0.2 else x])
        assert [(a, name) for a, _, name, _ in op.scan(text, t)] == slow_scan(text, t), text
    for name, x in lines:
        assert name in [f[2] for f in op.scan(f"some prose here {x} and some more prose", t)], x


def test_inheritance_equals_a_walk_up(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(150):
        folder = "/".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))
        kind = rng.random()
        name, text = ("LICENSE", rng.choice(["MIT License", "Apache License 2.0", "nothing"])) if kind < 0.2 else (f"f{i}.py", "GNU GPL 2.0" if kind < 0.3 else "code")
        rows.append((None if i == 9 else i, f"{folder}/{name}" if folder else name, text + f" key {i}", "k", "f"))
    given = {}
    own = lambda t: [n for n, s in (("MIT", "MIT"), ("Apache-2.0", "Apache"), ("GPL-2.0", "GNU")) if s in t]
    for _, path, t, *_ in rows:
        if path.endswith("LICENSE") and own(t) or own(t) and 2 * len("GNU GPL 2.0") >= len(t):
            given.setdefault(path.rpartition("/")[0], set()).update(own(t))
    want = []
    for i, path, t, *_ in rows:
        at, up = path.rpartition("/")[0], None
        while not own(t) and up is None:
            up = given.get(at)
            if not at:
                break
            at = at.rpartition("/")[0]
        want.append((str(i), own(t) or (sorted(up) if up else None)))
    d = spark.createDataFrame(rows, "doc_id long, path string, text string, key string, found string")
    assert sorted((str(r.doc_id), r.licenses) for r in op.license_scan(d).collect()) == sorted(want)


def test_ties_go_to_the_longer_then_the_first():
    t = op.Templates({"B-1": ("Boost Software License",), "A-1": ("Boost Software License",)})
    t.texts = []
    assert [x[2] for x in op.scan("Boost Software License", t)] == ["B-1"]
