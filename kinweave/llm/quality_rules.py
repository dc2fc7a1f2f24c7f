"""Line-first quality rules, with built-in functions only.

Every line of a text is judged by itself (punctuation, navigation, boilerplate); failing lines are removed, and
a document is rejected if the removed lines held too much of its text, or if it fails the base rules.

Defined results: a null or empty text has no words, fails the base rules and has an empty cleaned text; a null
doc_id is passed through; repeated rows get equal results; other columns are ignored by `judge` and kept by
`clean`, which replaces only `text` and `n_chars`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import SPACE


@dataclass(frozen=True)
class LineRules:
    #: A line fails when `|` and other separators make up more than this share of its words ...
    max_separator_share: float = 0.2
    #: ... or signs of [#*$%&|<>] do ...
    max_symbol_share: float = 0.3
    #: ... or words ending in `!!` do ...
    max_shout_share: float = 0.3
    #: ... or it has this many words and no sentence punctuation at all ...
    unpunctuated_words: int = 20
    #: ... or it is short and says one of these things.
    boilerplate_words: int = 12
    boilerplate: str = (
        r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (service|use)|subscribe to our|sign up (now|for)"
        r"|click here|enable javascript|follow us on|share this|read more|skip to content|back to top|powered by)"
    )
    #: A document is rejected when failing lines hold more than this share of its word characters.
    max_removed: float = 0.5


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Windows are keyed by a chained 64-bit hash of their three words; positions sorted by (key, position) put equal
    windows side by side, and the union of the intervals [p, p+2] is summed from the gaps between sorted positions.
    """
    keys = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(k: Column) -> Column:
        ordered = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))

        def sides(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["k"] == F.get(s, i - 1)["k"]) | (x["k"] == F.get(s, i + 1)["k"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return _let(_let(ordered, sides), total)

    return _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k))).cast("long")


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def judge(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and the cleaned text with its counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("t")).select("doc_id", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("all_lines"))
    # A projection of its own for each array, so that none is evaluated twice.
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter("all_lines", lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        _repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))

    def fails(x: Column) -> Column:
        # The counts are only made for lines that hold what they count: `&` stops at the first false side.
        words = count(x, r"[^ \t-\r]+")
        marked = x.rlike(r"[|»›•·#*$%&<>]|!!")
        navigation = count(x, r"[|»›•·]") > rules.max_separator_share * words
        symbols = count(x, r"[#*$%&|<>]") > rules.max_symbol_share * words
        shouting = count(x, r"!!") > rules.max_shout_share * words
        bare = ~x.rlike(r"[.!?…。！？।؟:;,]") & (words >= rules.unpunctuated_words)
        boiler = ~x.rlike(rf"^[ \t-\r]*+(?:[^ \t-\r]++[ \t-\r]++){{{rules.boilerplate_words}}}[^ \t-\r]") & x.rlike(rules.boilerplate)
        return (marked & (navigation | symbols | shouting)) | bare | boiler

    d = d.withColumn("good", F.filter("lines", lambda x: ~fails(x)))
    d = d.withColumn("kept_chars", F.char_length(F.regexp_replace(F.array_join("good", ""), SPACE + "+", "")).cast("long"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = (F.col("word_chars") - F.col("kept_chars")) > rules.max_removed * F.col("word_chars")
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~removed).alias("kept"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_removed_lines"),
        "kept_chars",
        F.array_join("good", "\n").alias("clean_text"),
    )


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, with their failing lines removed; the columns of `docs`, in their order."""
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = judge(docs.select(struct.alias("doc_id"), "text"), rules)
    # A plain filter on `kept` would be pushed below the projections, and each array be computed many times.
    judged = judged.withColumn("kept", F.when(F.monotonically_increasing_id() >= 0, F.col("kept"))).where("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("long")}
    return judged.select(*[new.get(c, F.col("doc_id")[c]).alias(c) for c in docs.columns])
