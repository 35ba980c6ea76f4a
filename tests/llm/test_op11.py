import json
import random
import re

import pytest

from heronry.llm import html_tree as H
from heronry.llm import op11_html as op


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(n))


def esc(text):
    return text.replace("&", "&amp;").replace("<", "&lt;")


def menu(rng):
    return "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(rng, 7).split()) + "</ul>"


def article(rng, blocks):
    """Blocks and how they are written; some with inner tags, references, lists and tables."""
    out, texts = [], []
    for k in range(blocks):
        t = words(rng, rng.randint(3, 60)) + rng.choice(["", " & co", " < x", " é 日本"])
        how = rng.randint(0, 5)
        if how == 0:
            out.append(f"<p>{esc(t)}")
        elif how == 1:
            a, b = t.split(" ", 1)
            out.append(f"<p><b>{esc(a)}</b>\n  <a href=x>{esc(b)}</a></p>")
        elif how == 2:
            out.append(f"<h2 class='t{k}'>{esc(t)}</h2>")
        elif how == 3:
            out.append(f"<ul><li>{esc(t)}</li></ul>")
        elif how == 4:
            out.append(f"<blockquote>{esc(t)}<!-- <p>old</p> --></blockquote>")
        else:
            out.append(f"<div><script>var x = '</p><p>no';</script>{esc(t)}</div>")
        texts.append(" ".join(t.split()))
    return "".join(out), texts


def semantic(rng, body, title):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class='no-sidebar'><header>Site {words(rng, 2)}</header><nav>{menu(rng)}</nav><div class=cookie-notice><p>We use cookies {words(rng, 4)}</p></div><main><article><h1>{title}</h1>{body}<div class='share-box'>Share</div></article><aside><h3>More</h3><p>{words(rng, 20)}</p></aside><section id=comments><article class=comment><p>{words(rng, 30)}</p></article></section></main><form><label>Mail</label><input name=q><p>Subscribe now</p></form><footer>&copy; {words(rng, 5)}</footer></body></html>"


def nested(rng, body, title):
    return f"<body><article><h1>{title}</h1>{body}<section><h2 class=comments>2 answers</h2><article><p>{words(rng, 6)}</p></article><article><p>{words(rng, 5)}</p></article></section></article></body>"


def divs(rng, body, title):
    """No names: only what changes from page to page tells the article."""
    return f"<html><body><div class=q1><div>Quality papers since 1921</div>{menu(rng)}</div><div class=z9><div class=k2><h1>{title}</h1>{body}</div></div><div class=u3><p>All rights are ours, all of them, in every place and for all times, as the law says.</p></div></body></html>"


def post(rng, body, title):
    return f"<body><div id=header>{words(rng, 3)}</div><div class=sidebar_left>{menu(rng)}<p>{words(rng, 25)}</p></div><div class='post hentry'><h1>{title}</h1><div class='post-content'>{body}<span class=advert>Buy {words(rng, 3)}</span></div></div><div id=commentList><p>{words(rng, 40)}</p></div></body>"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = []
    for k in range(240):
        host = rng.choices([("a.example", semantic), ("b.example", divs), ("c.example", post), (f"solo{k}.example", semantic), ("n.example", nested)], [8, 3, 3, 1, 2])[0]
        title = words(rng, 5)
        body, texts = article(rng, rng.randint(4, 12))
        page = host[1](rng, body, title)
        if k % 9 == 0:
            page = re.sub("</body>.*", "", page)
        rows.append((k, f"https://user@{host[0].upper()}:80/{k}?x=1", page, "\n".join([title, *texts])))
    return rows


def test_known_articles(spark, corpus):
    d = spark.createDataFrame([(*r[:3], 1, "x") for r in corpus], "page_id long, url string, html string, host int, text string")
    got = op.extract(d.repartition(5)).collect()
    assert [f for f in got[0].__fields__] == ["page_id", "url", "text", "n_chars"]
    want = {r[0]: r for r in corpus}
    assert len(got) == len(corpus)
    wrong = [r.page_id for r in got if r.text != want[r.page_id][3] or r.url != want[r.page_id][1] or r.n_chars != len(r.text)]
    assert not wrong, [(want[i][2][:1500], want[i][3], next(r.text for r in got if r.page_id == i)) for i in wrong[:1]]
    assert sorted(map(tuple, op.extract(d.repartition(3), fan_in=2).collect())) == sorted(map(tuple, got))  # seven rounds


def test_edges(spark):
    rows = [(1, None, None), (None, "http://x/1", ""), (2, "nonsense", "plain  text &amp; more"), (2, "nonsense", "plain  text &amp; more"), (3, "http://x/2", "<p>" + "long &eacute; " * 100_000), (4, "http://y", "<p>a<p>b<br>c<td>d</p><b>"), (5, "http://y", "<" * 50 + "<p x='1"), (6, "http://z", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "http://z", "<p>&#0;&#x41;&notanentity;&lt;b&gt;</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, op.extract(d).collect()), key=str)
    texts = {(p, u): t for p, u, t, _ in got}
    assert len(got) == len(rows) and texts[1, None] == "" and texts[None, "http://x/1"] == "" and texts[2, "nonsense"] == "plain text & more"
    assert texts[3, "http://x/2"] == " ".join(["long é"] * 100_000) and texts[4, "http://y"] == "a\nb c\nd" and texts[6, "http://z"] == "deep"
    assert texts[7, "http://z"] == "�A&notanentity;<b>".replace("&not", "¬")
    assert op.extract(d.limit(0)).collect() == []


def test_wrapper_in_writing(spark):
    page = lambda n, ad: f"<body><div class=top>x</div>{'<div class=box>ad</div>' if ad else ''}<div class=k>{'<h2>a</h2><p>b</p>' * n}</div></body>"
    rows = [(k, "http://h/", page(1 + k % 3, k % 2)) for k in range(6)]
    made = op.infer(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [tuple(r) for r in made] == [("h", 6, "<body><div.top>#</> (<div.box>#</>)? <div.k>(<h2>#</> <p>#</>)+</></>")]


def test_skeletons_fit_their_wrapper():
    """Nine slots in ten of a skeleton have one in the wrapper that it became part of, whatever the structure; others are chosen by the page itself."""
    rng, got, all_ = random.Random(1), 0, 0
    load = lambda x: H.load(json.loads(x))

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth and rng.random() < 0.7 else 'x'}</{t}>" for t in rng.choices(["div", "section", "ul", "h2", "p"], k=rng.randint(1, 5)))

    for _ in range(60):
        pages = [H.skeleton(tree(3))[1] for _ in range(5)]
        root = load(pages[0])
        for x in pages[1:]:
            H.merge(root, load(x))
        for page in map(load, pages):
            to = {}
            H.match(root.kids, page.kids, to)
            got, all_ = got + len(to), all_ + len(H.slots(page))
            assert len(H.kept(root, page)) == len(H.slots(page))
    assert got >= 0.9 * all_


def test_wrappers_are_bounded():
    """Elements of a thousand different classes become one by their tag; what they are stays."""
    pages = [H.skeleton(f"<body><div class='c{''.join(chr(97 + int(c)) for c in str(k))}'><p>x</p></div><div class='{chr(97 + k % 26)}x{chr(97 + k // 26)} comments'><p>y</p></div></body>")[1] for k in range(600)]
    root = H.load(json.loads(pages[0]))
    for x in pages[1:]:
        H.merge(root, H.load(json.loads(x)))
    assert len(json.dumps(H.dump(root))) < 20_000
    assert all(H.kept(root, H.load(json.loads(x))) == "10" for x in pages)
