"""Pages as trees of blocks, folded into skeletons; skeletons merged into wrappers.

An ``Item`` is an element or, with the signature ``#``, a slot for text. A list of items
with the marks optional, repeated and group is a regular expression without unions:
consecutive items of one group repeat together.
"""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

SLOT = "#"
#: Fixed values of HTML: elements without content, with raw text, and those inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
#: An opening tag ends these open ones, up to the nearest of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CELL = frozenset(("td", "th"))
P_BOUND = frozenset("table td th caption button object template html".split())
#: What is no article by its element, and by words of its class, id or role.
DROP_TAGS = frozenset("head nav footer aside form noscript template svg math button select input dialog menu datalist object canvas audio video map".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup signin login share sharing social related recommended recommendations "
    "popup modal overlay widget widgets pagination pager toolbar masthead hidden search complementary contentinfo form dialog".split()
)
HEAD_WORDS = frozenset(("header", "topbar"))
ARTICLE_WORDS = frozenset("article articlebody post entry story blogpost".split())
#: Elements that hold blocks; a region is one of these.
CONTAINERS = frozenset("html body div section article main td table tbody tr center blockquote".split())
DEEPEST = 100
PERIOD, MOST = 6, 64

_ATTRIBUTES = r"""((?>[^>"']|"[^"]*"|'[^']*')*+|[^>]*)"""
#: Slash, tag, attributes; or a text. Comments, declarations, raw text and a tag that never ends have none of these.
_TOKEN = re.compile(
    rf"""([^<]+)|<!--.*?(?:-->|\Z)|<(?i:({"|".join(sorted(RAW))}))(?=[\s/>]){_ATTRIBUTES.replace("(", "(?:", 1)}>.*?(?:</(?i:\2)(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*){_ATTRIBUTES}>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|(<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


class Item:
    """An element or slot of a page, skeleton or wrapper."""

    __slots__ = ("grp", "kids", "opt", "rep", "sig", "stats", "up")

    def __init__(self, sig: str, kids: list | None = None, opt: bool = False, rep: bool = False, grp: int = 0, stats: list | None = None):
        self.sig, self.kids, self.opt, self.rep, self.grp, self.stats, self.up = sig, kids if kids is not None else [], opt, rep, grp, stats, None

    def find(self) -> Item:
        """What this one was merged into."""
        at = self
        while at.up is not None:
            at = at.up
        return at


@lru_cache(65_536)
def signature(tag: str, attributes: str) -> str:
    """The tag, and the words without digits of class, id, role and itemprop; ``hidden`` too."""
    words = set()
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role", "itemprop"):
                words.update(w.lower() for w in _WORD.findall(value))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                words.add("hidden")
    return f"{tag}.{'-'.join(sorted(words))}" if words else tag


@lru_cache(65_536)
def kind(sig: str) -> str:
    """``drop``, ``words`` (dropped by its words), ``head``, ``article``, ``post`` (an article by its words), ``main`` or nothing."""
    tag, _, rest = sig.partition(".")
    words = set(rest.split("-")) if rest else set()
    if tag in DROP_TAGS:
        return "drop"
    if tag == "article":
        return "words" if words & {"comment", "comments", "reply", "hidden", "related", "ad", "promo"} else "article"
    if tag in ("html", "body"):
        return ""
    if tag == "main" or "main" in words and "role" not in words and tag == "div" and words <= {"main", "content", "container", "wrapper", "page", "site", "primary"}:
        return "main"
    if words & DROP_WORDS:
        return "words"
    if tag == "header" or words & HEAD_WORDS:
        return "head"
    return "post" if words & ARTICLE_WORDS and tag in CONTAINERS else ""


def generic(sig: str) -> str:
    """A signature without words; what it is stays."""
    tag, _, rest = sig.partition(".")
    what = kind(sig)
    return f"{tag}.{ {'words': 'hidden', 'head': 'header', 'post': 'post', 'main': 'main'}[what]}" if rest and what in ("words", "head", "post", "main") else tag


def parse(html: str) -> tuple[Item, list[tuple[Item, str, int]]]:
    """The page's tree, unfolded, and its blocks in order: slot, text, and how many characters of it are links."""
    root = Item("")
    stack, tags, blocks = [root], [""], []
    run: list[str] = []  # the text since the last border of a block
    linked: list[int] = []  # places in ``run`` where a link begins or ends
    inside: list[tuple[str, int, bool]] = []  # open links and dropped inline elements: tag, depth, dropped
    dropping = 0

    def flush():
        """What has been read since the last border is a block."""
        text = "".join(run)
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if text:
            links = 0
            if linked:
                at = [*linked, len(run)] if len(linked) % 2 else linked
                links = sum(len(" ".join(entities.unescape("".join(run[a:b])).split())) for a, b in zip(at[::2], at[1::2]))
            slot = Item(SLOT)
            stack[-1].kids.append(slot)
            blocks.append((slot, text, min(links, len(text))))
        run.clear()
        if linked:
            linked[:] = [0] if any(t == "a" and not d for t, _, d in inside) else []

    def shut(depth: int):
        """Close elements down to ``depth``, and inline ones opened in them."""
        nonlocal dropping
        if run:
            flush()
        del stack[depth:], tags[depth:]
        if inside:
            while inside and inside[-1][1] > depth:
                dropping -= inside.pop()[2]
            linked[:] = [0] if any(t == "a" and not d for t, _, d in inside) else []
        elif linked:
            linked.clear()

    for text, _, closing, tag, attributes, lone in _TOKEN.findall(html):
        if not tag:
            if (text or lone) and not dropping:
                run.append(text or lone)
            continue
        if not tag.islower():
            tag = tag.lower()
        if closing:
            if tag in INLINE:
                for k in range(len(inside) - 1, -1, -1):
                    if inside[k][0] == tag:
                        _, _, dropped = inside.pop(k)
                        dropping -= dropped
                        if tag == "a" and not dropped and len(linked) % 2:
                            linked.append(len(run))
                        break
            elif tag in tags:
                shut(len(tags) - 1 - tags[::-1].index(tag))
            elif tag == "p":
                shut(len(tags))
            continue
        if tag in VOID:
            if tag == "hr":
                shut(len(tags))
            elif tag == "br" and not dropping:
                run.append(" ")
            continue
        if tag in INLINE:
            if attributes and kind(signature(tag, attributes)) == "words" and not attributes.endswith("/"):
                dropping += 1
                inside.append((tag, len(tags), True))
            elif tag == "a":
                inside.append((tag, len(tags), False))
                if not len(linked) % 2:
                    linked.append(len(run))
            elif dropping:
                inside.append((tag, len(tags), False))
            continue
        if tag in ENDS:
            ends, bounds = ENDS[tag]
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in ends:
                    shut(k)
                    break
                if tags[k] in bounds:
                    break
        elif "p" in tags:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] == "p":
                    shut(k)
                    break
                if tags[k] in P_BOUND:
                    break
        if run:
            flush()
        if attributes and attributes.endswith("/") and tag not in CONTAINERS and tag != "p":
            continue
        if len(stack) < DEEPEST:
            node = Item(signature(tag, attributes) if attributes else tag)
            stack[-1].kids.append(node)
            stack.append(node)
            tags.append(tag)
    shut(1)
    return root, blocks


def fold(items: list[Item]) -> list[Item]:
    """Neighbours of one signature become one repeated item; runs of up to PERIOD items that repeat, one group."""
    out: list[Item] = []
    for i in items:
        if out and out[-1].sig == i.sig:
            merge(out[-1], i)
            out[-1].rep = True
        else:
            out.append(i)
    for w in range(2, PERIOD + 1):
        k = 0
        while k + 2 * w <= len(out):
            if all(out[k + j].sig == out[k + w + j].sig for j in range(w)):
                grp = max((i.grp for i in out), default=0) + 1
                grp = next((i.grp for i in out[k : k + w] if i.grp), grp)
                for j in range(w):
                    merge(out[k + j], out[k + w + j])
                    out[k + j].grp = grp
                del out[k + w : k + 2 * w]
            else:
                k += 1
    return out


def merge(a: Item, b: Item) -> None:
    """``b`` becomes part of ``a``."""
    a.opt, a.rep, b.up = a.opt or b.opt, a.rep or b.rep, a
    a.grp = a.grp or b.grp
    if a.stats is None:
        a.stats = b.stats
    elif b.stats is not None:
        (n, lo, hi, c, k), (m, low, high, d, x) = a.stats, b.stats
        a.stats = [n + m, min(lo, low), max(hi, high), c + d, k + x]
    if b.kids:
        a.kids = align(a.kids, b.kids)


def align(x: list[Item], y: list[Item]) -> list[Item]:
    """Two lists of items in one: what both have is merged, the rest is optional, and what then repeats is folded."""
    left, right = [i.sig for i in x], [i.sig for i in y]
    if left == right:
        for a, b in zip(x, y):
            merge(a, b)
        return x
    top = max((i.grp for i in x), default=0)
    for i in y:
        i.grp += top if i.grp else 0
    out: list[Item] = []
    for what, a, b, c, d in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            for i, j in zip(x[a:b], y[c:d]):
                merge(i, j)
                out.append(i)
        else:
            for i in [*x[a:b], *y[c:d]]:
                i.opt = True
                out.append(i)
    out = fold(out)
    return generalised(out) if len(out) > MOST else out


def generalised(items: list[Item]) -> list[Item]:
    """Items in any order, one for each signature without words; bounds what one element of a wrapper holds."""
    kept: dict[str, Item] = {}
    for i in items:
        i.sig = generic(i.sig)
        if i.sig in kept:
            merge(kept[i.sig], i)
        kept.setdefault(i.sig, i)
        kept[i.sig].opt = kept[i.sig].rep = True
    return list(kept.values())


def fold_all(item: Item) -> None:
    """Fold a page's tree from its leaves up."""
    for i in item.kids:
        fold_all(i)
    item.kids = fold(item.kids)


def slots(item: Item, out: list[Item] | None = None) -> list[Item]:
    """Slots in order."""
    out = [] if out is None else out
    for i in item.kids:
        if i.sig == SLOT:
            out.append(i)
        else:
            slots(i, out)
    return out


def dump(item: Item) -> list:
    """As lists, for JSON."""
    return [item.sig, item.opt + 2 * item.rep, item.grp, [dump(i) for i in item.kids], item.stats]


def load(x: list) -> Item:
    """From lists."""
    return Item(x[0], [load(i) for i in x[3]], bool(x[1] & 1), bool(x[1] & 2), x[2], x[4])


def skeleton(html: str) -> tuple[str, str, list[tuple[int, str, int]]]:
    """A page's digest of the folded tree, that tree as JSON, and its blocks: number of the slot, text, linked characters."""
    root, blocks = parse(html)
    fold_all(root)
    number = {id(s): k for k, s in enumerate(slots(root))}
    text = json.dumps(dump(root), separators=(",", ":"), ensure_ascii=False)
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest(), text, [(number[id(s.find())], t, n) for s, t, n in blocks]


def regex(item: Item) -> str:
    """A wrapper in writing: ``?`` optional, ``+`` repeated, ``( )+`` a group that repeats."""
    out, k, kids = [], 0, item.kids
    while k < len(kids):
        j = k + 1
        while kids[k].grp and j < len(kids) and kids[j].grp == kids[k].grp:
            j += 1
        each = []
        for i in kids[k:j]:
            body = SLOT if i.sig == SLOT else f"<{i.sig}>{regex(i)}</>"
            rep = i.rep or bool(i.grp and j == k + 1)
            mark = "" if not (rep or i.opt) else "+" if rep and not i.opt else "*" if rep else "?"
            each.append(f"({body}){mark}" if mark and i.sig != SLOT else body + mark)
        out.append(f"({' '.join(each)})+" if j > k + 1 else each[0])
        k = j
    return " ".join(out)


def match(wrapper: list[Item], page: list[Item], to: dict[int, Item]) -> None:
    """Which slot of the wrapper each of a skeleton's slots is, by the id of the slot's item."""
    left, right = [i.sig for i in wrapper], [i.sig for i in page]
    pairs, rest = [], []
    if left == right:
        pairs = list(zip(wrapper, page))
    else:
        for what, a, b, c, d in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
            if what == "equal":
                pairs += zip(wrapper[a:b], page[c:d])
            else:
                rest += page[c:d]
    if rest:
        by: dict[str, Item] = {}
        for i in wrapper:
            by.setdefault(i.sig, i)
        pairs += [(by.get(i.sig) or by.get(generic(i.sig)), i) for i in rest]
    for w, i in pairs:
        if w is not None:
            if i.sig == SLOT:
                to[id(i)] = w
            else:
                match(w.kids, i.kids, to)


def chosen(root: Item) -> set[int]:
    """The ids of the slots of a wrapper or skeleton that hold the main text.

    Slots in elements that are no article by name or by their words go. Of the rest those in articles stay,
    or else those in what is an article by its words, or in the main element, if they hold three tenths
    of the text; if there is none, those of the smallest element with most of the text, without
    slots that have the same text on all of three pages or more while others change, and without lists and tables of links.
    """
    chars: dict[int, int] = {}
    rows: list[tuple[Item, list[Item], str]] = []  # slot, the elements around it, why it goes

    def measure(i: Item) -> int:
        n = (i.stats[3] if i.stats else 1) if i.sig == SLOT else sum(map(measure, i.kids))
        chars[id(i)] = n
        return n

    def holds(i: Item) -> bool:
        return any(kind(x.sig) in ("article", "main") or holds(x) for x in i.kids if x.sig != SLOT)

    def walk(i: Item, path: list[Item], why: str, article: Item | None, main: bool):
        for x in i.kids:
            if x.sig == SLOT:
                rows.append((x, path, why))
                continue
            what, off = kind(x.sig), why
            if not off:
                if what == "drop" or (what == "head" and article is None and not main and not holds(x)):
                    off = "drop"
                elif what == "words" and not holds(x):
                    off = "words"
                elif what == "article" and article is not None and 2 * chars[id(x)] < chars[id(article)]:
                    off = "drop"  # an article inside another is a comment on it
            walk(x, [*path, x], off, x if what == "article" and article is None else article, main or what == "main")

    total = measure(root)
    walk(root, [root], "", None, False)
    live = [(s, path) for s, path, why in rows if not why] or [(s, path) for s, path, why in rows if why == "words"]
    if not live or not total:
        return set()
    text = sum(chars[id(s)] for s, _ in live)
    for what in ("article", "post", "main"):
        some = [s for s, path in live if any(kind(i.sig) == what for i in path)]
        if some and 10 * sum(chars[id(s)] for s in some) >= 3 * text:
            return set(map(id, some))
    fixed = lambda s, path: s.stats and s.stats[0] >= 3 and s.stats[1] == s.stats[2] and not any(i.rep or i.grp for i in [s, *path])
    changing = [(s, path) for s, path in live if not fixed(s, path)] or live
    plain = [(s, path) for s, path in changing if not s.stats or 2 * s.stats[4] <= s.stats[3]] or changing
    whole, region = sum(chars[id(s)] for s, _ in plain), root
    own: dict[int, int] = {}
    for s, path in plain:
        for i in path:
            own[id(i)] = own.get(id(i), 0) + chars[id(s)]
    while nexts := [i for i in region.kids if i.sig.partition(".")[0] in CONTAINERS and not i.grp and 10 * own.get(id(i), 0) >= 8 * whole]:
        region = nexts[0]
    listed = lambda path: any(i.sig.partition(".")[0] in ("ul", "ol", "dl", "table") for i in path)
    dense = {id(s) for s, path in changing if listed(path)} - {id(s) for s, _ in plain}
    return {id(s) for s, path in changing if id(s) not in dense and any(i is region for i in path)}


def kept(wrapper: Item, page: Item) -> str:
    """A mark, 1 or 0, for each slot of a skeleton: whether it holds main text by its host's wrapper, or by itself where the wrapper has no such slot."""
    to: dict[int, Item] = {}
    match(wrapper.kids, page.kids, to)
    yes, own = chosen(wrapper), None
    found = slots(page)
    marks = []
    for s in found:
        w = to.get(id(s))
        if w is None:
            own = chosen(page) if own is None else own
        marks.append(id(w) in yes if w is not None else id(s) in own)
    if not any(marks):
        own = chosen(page) if own is None else own
        marks = [id(s) in own for s in found]
    return "".join("01"[m] for m in marks)
