"""Language identification by interpolated Kneser-Ney character models.

Training texts are lower-cased; everything but letters becomes one space. For each
language the models of orders 1 to ``ORDER`` have raw counts at the highest order
and numbers of distinct left neighbours below, one discount n1 / (n1 + 2 * n2) an
order, and interpolate down to a uniform share of the alphabet. The models are kept
together: for each order one sorted array of 64-bit hashes of all n-grams that any
language has seen with a row of finished log probabilities by language beside it,
and one of contexts with rows of back-off weights. A character looks up its longest
n-gram by binary search and backs off where no language has it.

The language with the lowest cross-entropy a character wins, the first by name if
equal. A text is rejected if that cross-entropy is above a limit fitted on
training texts that the counts leave out: their 99.5th percentile, times
``SLACK``, plus ``SHORT`` bits over the root of the text's length.

The models are fitted on the driver from a bounded sample of labelled texts:
about ``CHARS`` characters a language and ``ALL_CHARS`` in all, chosen by a hash
of id and text at a share that has no least value; of each text at most its first characters, a tenth of a language's bound.
The alphabet has the 4,093 letters that are most frequent there; all others, such as rare
Han signs, are one further letter.
Prediction reads every whole text, and nothing but the text.

A null text or one without letters gives ``und``, score 0, rejected; with no
labelled text at all every prediction is ``und``; ids may be null or repeat; other
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import id_field, map_texts

ORDER, BITS = 5, 12
CHARS, ALL_CHARS = 2_500_000, 20_000_000
SLACK, SHORT = 1.25, 6.0
UND = "und"
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, with 0 before each one ORDER - 1 times; start of each text's own."""
    gap = "\0" * (ORDER - 1)
    joined = gap + gap.join(t.lower().replace("\0", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    zero = points == 0
    points = np.where(letters()[points] | zero, points, np.uint32(32))
    space = points == 32
    keep = ~(space & np.concatenate(([True], space[:-1] | zero[:-1])))
    points = points[keep]
    zeros = np.cumsum(points == 0)
    starts = np.searchsorted(zeros, (ORDER - 1) * np.arange(1, len(texts) + 1), side="left") + 1
    return points, starts


class Models:
    """Fitted models; small enough to send to every executor."""

    def __init__(self, texts: list[str], langs: list[str], held: list[bool] | None = None):
        self.langs = sorted(set(langs))
        self.limit: np.ndarray = np.zeros(len(self.langs))
        if not self.langs:
            return
        held = held or [False] * len(texts)
        by = {g: [t for t, x, h in zip(texts, langs, held) if x == g and not h] or [t for t, x in zip(texts, langs) if x == g] for g in self.langs}
        points, count = np.unique(np.concatenate([sequence(by[g])[0] for g in self.langs]), return_counts=True)
        common = points[np.argsort(-count, kind="stable")][: (1 << BITS) - 3]
        self.alphabet = np.zeros(0x110000, dtype=np.uint16)
        self.alphabet[:] = 1  # any other
        self.alphabet[np.sort(common[common != 0])] = np.arange(2, 2 + np.count_nonzero(common))
        self.alphabet[0] = 0
        self._fit([self.coded(by[g])[0] for g in self.langs])
        self._calibrate(texts, langs, held)

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, starts = sequence(texts)
        return self.alphabet[points].astype(np.uint64), starts

    @staticmethod
    def grams(codes: np.ndarray, order: int) -> np.ndarray:
        """The n-gram that ends at each place; exact, as order * BITS bits."""
        key = codes.copy()
        for j in range(1, order):
            key[j:] |= codes[:-j] << np.uint64(BITS * j)
        return key

    def _fit(self, sequences: list[np.ndarray]) -> None:
        n, size = len(sequences), len(np.unique(self.alphabet)) - 1
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for codes in sequences:
            key = self.grams(codes, ORDER)[codes > 0]
            grams, c = np.unique(key, return_counts=True)
            counts[ORDER].append((grams, c))
            for k in range(ORDER - 1, 0, -1):
                grams, c = np.unique(grams & np.uint64((1 << (BITS * k)) - 1), return_counts=True)
                counts[k].append((grams, c))
        self.tables, below = [], None
        for k in range(1, ORDER + 1):
            union = np.unique(np.concatenate([g for g, _ in counts[k]]))
            contexts = np.unique(union >> np.uint64(BITS))
            ctx = np.searchsorted(contexts, union >> np.uint64(BITS))
            lower = np.full((len(union), n), 1.0 / size) if below is None else below[1][np.searchsorted(below[0], union & np.uint64((1 << (BITS * (k - 1))) - 1))]
            p, back = np.empty((len(union), n)), np.ones((len(contexts), n))
            for i, (grams, c) in enumerate(counts[k]):
                n1, n2 = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                at = np.searchsorted(contexts, grams >> np.uint64(BITS))
                total = np.bincount(at, c, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                back[seen, i] = d * kinds[seen] / total[seen]
                own = np.zeros(len(union))
                own[np.searchsorted(union, grams)] = c - d
                p[:, i] = own / np.maximum(total, 1)[ctx] + back[ctx, i] * lower[:, i]
            below = union, p
            self.tables.append((self._sorted(union, np.log2(p)), self._sorted(contexts, np.log2(back))))
        self.floor = -np.log2(size)

    @staticmethod
    def _sorted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys)
        order = np.argsort(h)
        return h[order], rows[order].astype(np.float32)

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character by text and language, and characters by text."""
        codes, starts = self.coded(texts)
        own = np.flatnonzero(codes > 0)
        gained = np.zeros((len(own), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(own))
        full = self.grams(codes, ORDER)[own]
        for k in range(ORDER, 0, -1):
            if not len(open_):
                break
            (h, rows), (ch, crows) = self.tables[k - 1]
            key = full[open_] & np.uint64((1 << (BITS * k)) - 1)
            hit, at = self._find(h, mixed(key))
            gained[open_[hit]] += rows[at]
            open_, key = open_[~hit], key[~hit]
            hit, at = self._find(ch, mixed(key >> np.uint64(BITS)))
            gained[open_[hit]] += crows[at]
        gained[open_] += np.float32(self.floor)
        run = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(gained, axis=0, dtype=np.float64)))
        edge = np.searchsorted(own, np.append(starts, len(codes) + 1))
        n = np.diff(edge)
        return -(run[edge[1:]] - run[edge[:-1]]) / np.maximum(n, 1)[:, None], n

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        hit = table[at] == keys
        return hit, at[hit]

    def _calibrate(self, texts, langs, held) -> None:
        for i, g in enumerate(self.langs):
            own = [t for t, x, h in zip(texts, langs, held) if x == g and h] or [t for t, x in zip(texts, langs) if x == g]
            bits, n = self.bits(own)
            known = bits[n > 50, i] if (n > 50).any() else bits[:, i]
            self.limit[i] = SLACK * float(np.quantile(known, 0.995))

    def predict(self, texts: list[str]):
        """Language, score, bits a character and acceptance of each text."""
        out = [(UND, 0.0, None, False)] * len(texts)
        if not self.langs:
            return out
        bits, n = self.bits(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        score = 1.0 / np.exp(-np.log(2) * np.sqrt(n)[:, None] * (bits - least[:, None])).sum(axis=1)
        accept = least <= self.limit[best] + SHORT / np.sqrt(np.maximum(n, 1))
        has = np.array([any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in texts])
        return [(self.langs[b], float(s), float(v), bool(a)) if h else o for b, s, v, a, h, o in zip(best, score, least, accept, has, out)]


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def drawn(share, *of):
    """Whether the 64-bit hash of columns, as a fraction of its range, is below ``share``."""
    return F.xxhash64(*of).cast("double") / 2.0**64 + 0.5 < share


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = CHARS, all_chars: int = ALL_CHARS) -> Models:
    """Models from a bounded sample of labelled rows; hold rows out before."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = F.length(text_col)
    each = min(chars, all_chars // max(1, known.select(lang_col).distinct().count()))
    most = max(1, each // 10)  # characters of one text, its first ones
    sums = known.groupBy(lang_col).agg(F.sum(F.least(n, F.lit(most))).alias("n")).collect()
    share = F.lit(0.0)
    for r in sums:
        share = F.when(F.col(lang_col) == r[0], F.lit(each / max(1, r["n"]))).otherwise(share)
    rows = known.filter(drawn(share, F.col(id_col), F.col(text_col), F.lit("lang"))).select(F.substring(text_col, 1, most), lang_col, F.pmod(F.xxhash64(F.col(id_col), F.lit("held")), F.lit(5)) == 0).collect()
    rows.sort()
    return Models([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, bits, accepted."""
    schema = T.StructType([id_field(docs, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work(ids, texts):
        lang, score, bits, accepted = zip(*shared.value.predict(texts))
        return {id_col: ids, "lang_pred": lang, "score": score, "bits": bits, "accepted": accepted}

    return map_texts(docs, work, schema, id_col, text_col)
