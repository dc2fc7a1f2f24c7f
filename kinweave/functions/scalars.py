"""Scalar functions as column expressions; Jaro-Winkler and Double Metaphone are the vectorised exceptions."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(c: Column) -> Column:
    """Trimmed lower case; null for blank."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def clean_name(c: Column) -> Column:
    """Letters a to z of the lower-cased name; null for blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[^a-z]", ""), F.lit(""))


def upper_key(c: Column) -> Column:
    """Letters A to Z of the upper-cased name; null for blank."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z]", ""), F.lit(""))


def to_int(c: Column) -> Column:
    """The integer a text begins with."""
    return F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int")


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "t", "1", "yes", "y"), F.lit(False))


def year_range(c: Column) -> Column:
    """(lo, hi) over all runs of three or four digits."""
    years = F.transform(F.regexp_extract_all(c.cast("string"), F.lit(r"(\d{3,4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.struct(F.array_min(years).alias("lo"), F.array_max(years).alias("hi"))


def parse_seq(mention_id: Column) -> Column:
    """The last number of a mention id, without a duplicate's suffix."""
    return F.nullif(F.regexp_extract(mention_id, r"-(\d+)(?:\.\d+)?$", 1), F.lit("")).cast("long")


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's entry, or the value itself."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(table.items()))])
    return F.coalesce(F.try_element_at(pairs, c), c)


def round3(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def height_in_inches(c: Column) -> Column:
    """`5 ft 8 in` as `68.0`; values without feet or inches, or with none of them, as they are."""
    feet = F.regexp_extract(c, r"(?i)(\d+)\s*ft", 1).try_cast("double") * 12
    inches = F.regexp_extract(c, r"(?i)([\d.]+)\s*in", 1).try_cast("double")
    total = F.coalesce(feet, F.lit(0.0)) + F.coalesce(inches, F.lit(0.0))
    return F.when(total > 0, total.cast("string")).otherwise(c)


def first_year(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")


# Military and courtesy titles.
PREFIXES = ("PVT", "COL", "SGT", "MR", "DR", "CAPT", "MRS", "LTC", "LT", "CPL", "PFC", "REV", "1SGT", "CPT", "MAJ", "GEN", "ENS", "CORP")


def strip_prefixes(c: Column, bare: bool = True) -> Column:
    """A name without its stacked titles, each followed by a blank, a dot or (`bare`) the name's end."""
    titles = "|".join(sorted(PREFIXES, key=lambda p: (-len(p), p)))
    after = r"(?:[. ]+|$)" if bare else r"[. ]+"
    return F.regexp_replace(c, rf"(?i)^(?:(?:{titles}){after})+", "")


def strip_punctuation(c: Column) -> Column:
    """Without punctuation other than quotes and without `_`; spaces squeezed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s'\"“”‘’]", ""), "_", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def enumerator_bonus(enum_a: Column, date_a: Column, enum_b: Column, date_b: Column) -> Column:
    """Up to .5 for schedule and census rows of one enumerator on near days; dates are `month.day`."""
    part = lambda d, i: F.split(F.trim(d), r"\.").getItem(i).try_cast("int")
    # Days beyond a month's end run over into the next, as calendar arithmetic does.
    day = lambda d: F.date_add(F.date_trunc("MM", F.make_date(F.lit(1850), part(d, 0), F.lit(1))).cast("date"), part(d, 1) - 1)
    days = F.when(part(date_a, 0) == part(date_b, 0), F.abs(part(date_a, 1) - part(date_b, 1))).otherwise(F.abs(F.datediff(day(date_a), day(date_b))))
    number = F.floor(F.abs(F.trim(date_a).try_cast("double") - F.trim(date_b).try_cast("double")) * 100 + 0.5) / 100
    bonus = F.when((days == 0) | (number == 0), 0.5).when((days <= 1) | (number <= 0.1001), 0.4).when((days <= 2) | (number <= 0.2001), 0.3).when((days <= 7) | (number <= 0.7001), 0.2).otherwise(0.0)
    same = F.upper(F.trim(enum_a)) == F.upper(F.trim(enum_b))
    return F.coalesce(F.when(same & (F.trim(enum_a) != ""), bonus), F.lit(0.0))


def metaphone_agreement(a: Column, b: Column) -> Column:
    """Two `primary:secondary` codes: 1, .8, .6, 0; null when either is missing, 0 when either has no letter.

    A code without secondary part has the primary one twice.
    """
    part = lambda c, i: F.nullif(F.regexp_replace(F.upper(F.get(F.split(c, ":"), F.lit(i))), "[^A-Z]", ""), F.lit(""))
    pa, pb = part(a, 0), part(b, 0)
    sa, sb = F.coalesce(part(a, 1), pa), F.coalesce(part(b, 1), pb)
    score = F.when(pa.isNull() | pb.isNull(), 0.0).when(pa == pb, 1.0).when((pa == sb) | (sa == pb), 0.8).when(sa == sb, 0.6).otherwise(0.0)
    return F.when((F.trim(a) != "") & (F.trim(b) != ""), score)


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro-Winkler with a prefix bonus at any similarity; half transpositions are kept; 0 for a blank name."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free, taken = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                taken.append(c)
                break
    if not taken:
        return 0.0
    other = [c for c, f in zip(b, free, strict=True) if not f]
    m, t = len(taken), sum(x != y for x, y in zip(taken, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([known[k] if k in known else known.setdefault(k, jaro_winkler(*k)) for k in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler_upper(a: str | None, b: str | None) -> float:
    """The schedule matcher's variant: upper case, nothing stripped, two blanks are equal."""
    a, b = (a or "").upper(), (b or "").upper()
    return 1.0 if a == b else jaro_winkler(a, b)
