"""Identifiers in cells and texts: where they stand, how they are compared, and what they are there for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters, digits and inner signs of identifiers, in both widths.
SIGN = "A-Za-z0-9Ａ-Ｚａ-ｚ０-９"
TOKEN = re.compile(rf"(?<![{SIGN}_＿])[{SIGN}][{SIGN}_.:/\-．／－：＿]+[{SIGN}](?![{SIGN}_＿])")
LETTER, DIGIT, INNER = re.compile("[A-Za-zＡ-Ｚａ-ｚ]"), re.compile("[0-9０-９]"), re.compile(r"[_\-/:]")
LONGEST, MOST = 256, 128
#: Headers of references, words before a list of references, and what headers of a record's own identifier name.
REFERENCES = ("呼び出し先", "呼出先", "真遷移先", "偽遷移先", "遷移先", "遷移元", "発生段落", "参照先", "参照元", "リンク先", "接続先", "転送先", "依存先", "参照", "親id", "子id", "関連id")
BEFORE = re.compile(r"(?:^|[\s、,;；。．.!?！？(\[【])(真遷移先|偽遷移先|遷移先|発生段落|参照先|参照|呼び出し先|呼出先|真|偽)\s*[:：=＝]\s*")
OWN = re.compile(r"(?:段落|処理|エラー|画面|項目|レコード|テーブル|機能|業務|手続|帳票|api|ジョブ|バッチ|メッセージ|トランザクション)(?:id|識別子)")
_BETWEEN = re.compile(r"[\s,，、]*")
FIELDS = "array<struct<start:int,end:int,value:string,normalized:string,role:string,basis:string>>"


def normalized(value: str) -> str:
    """For comparison only: compatibility forms and case folded."""
    return unicodedata.normalize("NFKC", value).casefold()


def listed_after(text: str) -> str | None:
    """The last word of reference before the text's end with nothing but identifiers and commas behind it."""
    for m in reversed(list(BEFORE.finditer(text))):
        rest = TOKEN.sub("\0", text[m.end() :])
        if _BETWEEN.fullmatch(rest.replace("\0", "")) and (not rest or "\0" in rest):
            return m[1]
    return None


def role(label: str, before: str, key: bool) -> tuple[str, str]:
    """(role, why): reference by header or by a word before it, record_identity in a record's key, else unclassified."""
    label = normalized(label or "").strip()
    close = re.sub(r"\s+", "", label)
    mark = next((m for m in REFERENCES if m in close), None)
    if mark:
        return "reference", f"field_reference:{mark}"
    mark = listed_after(before)
    if mark:
        return "reference", f"inline_reference_marker:{mark}"
    leaf = re.sub(r"\s+", "", re.split(r"\s*>\s*|[/／・]", label)[-1])
    if leaf in ("id", "識別子") or OWN.fullmatch(leaf):
        return ("record_identity", f"record_key_identity:{leaf}") if key else ("unclassified", "identity_label_not_record_key")
    return "unclassified", "unsupported_field_label" if label else "missing_field_label"


def found(text: str | None, label: str | None = "", key: bool = False) -> list[dict]:
    """Identifiers of a text; places are of the text as it is, not of its folded form. Plain words have no digit and no inner sign."""
    out = []
    for m in TOKEN.finditer(text or ""):
        value = m[0]
        folded = normalized(value)
        if len(value) > LONGEST or not LETTER.search(value) or not (DIGIT.search(value) or INNER.search(folded)):
            continue
        what = ("unclassified", "ambiguous_slash_compound") if "/" in folded else role(label or "", text[: m.start()], key)
        out.append({"start": m.start(), "end": m.end(), "value": value, "normalized": folded, "role": what[0], "basis": what[1]})
    return out


def mentions(cells: DataFrame, value: str = "value", label: str = "label", key: str = "is_key", most: int = MOST) -> DataFrame:
    """``cells`` with mentions, at most ``most`` of them, and mention_count, all of them."""

    @F.pandas_udf(FIELDS)
    def every(v: pd.Series, names: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([found(t, n, bool(k)) for t, n, k in zip(v, names, keys)])

    at = cells.withColumn("__m", every(F.col(value).cast("string"), F.coalesce(F.col(label), F.lit("")), F.coalesce(F.col(key), F.lit(False))))
    return at.withColumn("mentions", F.slice("__m", 1, most)).withColumn("mention_count", F.size("__m")).drop("__m")
