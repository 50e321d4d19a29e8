"""Text expressions: normalising, hashing, bigrams, entities, similarity, codes, media."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes of names and of noise, legal forms and separators of company names, outlets of tier 2,
# titles of strong filings.
ENTITY = "[一-龥ー]{2,}|[ァ-ヶー]{2,}"
NOISE = r"[\s、。,\.　「」『』（）()【】\-—―:：/／]+"
LEGAL_FORMS = r"株式会社|\(株\)|有限会社|合同会社"
SEPARATORS = r"(?U)[\s・･.\-‐－ー_]"
TIER_2_OUTLETS = [
    "NHK", "日本経済新聞", "日経クロステック", "朝日新聞", "読売新聞", "毎日新聞", "産経新聞", "共同通信", "時事通信", "ロイター", "Reuters", "ブルームバーグ", "Bloomberg",
    "東洋経済オンライン", "ダイヤモンド・オンライン",
]
STRONG = ["大量保有報告書", "変更報告書", "公開買付", "TOB", "資本業務提携", "業務提携", "業績予想の修正", "業績予想を修正", "上方修正", "下方修正"]


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def normal_space(c: Column) -> Column:
    """Runs of Unicode white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)" + NOISE, "")


def bind(value: Column, use) -> Column:
    """use(value) with the value taken once: inside a lambda an outer expression would run anew for each element."""
    return F.transform(F.array(value), use)[0]


def bigrams(c: Column) -> Column:
    """Distinct character pairs of the stripped text; one character is itself, none gives an empty array."""
    chars = F.array_remove(F.split(stripped(c), ""), "")
    pairs = lambda s: F.array_distinct(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.concat(a, b)))
    return bind(chars, lambda s: F.when(F.size(s) > 1, pairs(s)).otherwise(s))


def entities(c: Column, pattern: str = ENTITY) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Size of intersection over size of union; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def novelty_hash(title: Column, names: Column) -> Column:
    top = F.array_join(F.slice(F.array_sort(names), 1, 3), "|")
    return sha256(F.concat(top, F.lit("::"), stripped(normal_space(title))))


def is_strong(c: Column, kinds: list[str] | None = None) -> Column:
    return F.coalesce(c.rlike("|".join(kinds or STRONG)), F.lit(False))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "&nbsp;", " "))


def security_code(c: Column) -> Column:
    """Five digits are cut to four; blank is null."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{5}$"), F.substring(t, 1, 4)).when(t != "", t)


def title_media(c: Column) -> Column:
    """What follows the last " - " of a headline, or an empty string."""
    return F.trim(F.regexp_extract(c, r"\s-\s([^-]+)$", 1))


def title_without_media(title: Column, media: Column) -> Column:
    """The headline without " - " and the outlet at its end."""
    tail = F.concat(F.lit(" - "), media)
    cut = F.when((media != "") & F.endswith(title, tail), F.left(title, F.length(title) - F.length(tail))).otherwise(title)
    return normal_space(cut)


def outlet_tier(media: Column) -> Column:
    return F.when(media.isin(TIER_2_OUTLETS), 2).otherwise(3)


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode compatibility form, which has no built-in."""
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def company_name(c: Column) -> Column:
    """Names for comparison: compatibility form, without legal forms and separators, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfkc(c), LEGAL_FORMS, ""), SEPARATORS, ""))


def jst_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Tokyo"))


def percent_encoded(c: Column) -> Column:
    """URL encoding with %20 for blanks."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def a_year_later(d: Column) -> Column:
    """The same day of the next year; for 29 February the date 365 days on."""
    return F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), F.date_add(d, 365)).otherwise(F.add_months(d, 12))
