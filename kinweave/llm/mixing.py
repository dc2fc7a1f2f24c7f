"""Mixing sources to target weights, with built-in functions only.

Leaves of a tree (domain, language, source) get token budgets from the root down.  A node's budget is shared
among its children by weight; a child that holds less than its share (its documents, repeated `max_epochs` times)
gets what it holds, and its shortage goes to its siblings by weight.  A subtree's capacity is what all its leaves
hold, so a shortage leaves the subtree, for the ancestors' other children, only when every sibling is exhausted.
All of it is integer arithmetic in windows over the tree, which has a row for each domain, language and source.

A leaf's budget is then filled with whole epochs and a prefix of one more.  Each epoch has an order of its own,
by a seeded digest of epoch and doc_id; the prefix takes documents in that order while their token sum fits.  The
running sum is never taken over a whole leaf: documents are summed in hash-range buckets sized by the leaf's
number of documents, and only the bucket in which the prefix ends is looked at row by row.  What is left of it is
the last (digest, tokens) that the prefix takes in each leaf, to which every row is compared by itself.

Defined results: null lang, source or domain count as the empty name; null and empty texts have 0 tokens and join
every prefix that reaches their place; a leaf without tokens is selected once if its budget's node exists at all;
repeated rows count each; rows of a leaf with equal doc_id and tokens are taken by the prefix together or not at all;
extra columns, also ones named like internal ones, are kept; very long texts are only measured; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, discard, materialize

LEVELS = ("domain", "lang", "source")


def numbered_domain(source: Column) -> Column:
    """A domain from the number a source's name ends in; `other` where it has none."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(n == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.expr("try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS bigint)") % 4).cast("string")))


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


@dataclass(frozen=True)
class Mix:
    #: Integer weights by name, for each level; names that aren't listed have weight `other`.
    weights: Sequence[dict[str, int]] = field(default_factory=lambda: ({"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, {"en": 6, "de": 2, "fr": 2, "es": 2}, {}))
    other: int = 1
    #: The budget: this part of the corpus' tokens (numerator, denominator), or a number of tokens.
    share: tuple[int, int] = (3, 5)
    budget: int | None = None
    max_epochs: int = 2
    seed: int = 42
    #: Documents of one bucket of a leaf, about.
    bucket_rows: int = 5_000


def _weight(name: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, w in table.items():
        out = F.when(name == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share column `budget` (the parent's) among siblings by weight `w`, `cap` at most: column `own`."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), name)
    past = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("past", past).withColumn("left", left)
    # The first child, by capacity for its weight, whose capacity reaches its share of what is left.
    fits = (F.col("budget") - F.col("past")) * F.col("w") <= F.col("cap") * F.col("left")
    turn = F.first(F.when(fits, F.struct("past", "left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nodes = nodes.withColumn("turn", turn)
    share = F.expr("(budget - turn.past) * w DIV turn.left")
    return nodes.withColumn("own", F.when(F.col("turn").isNull(), F.col("cap")).otherwise(F.least("cap", share))).drop("past", "left", "turn")


def allocate(leaves: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Leaves (domain, lang, source, tokens, n_docs) with their `leaf_budget`."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = mix.budget if mix.budget is not None else total * mix.share[0] // mix.share[1]
    base = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    given = None
    for depth, name in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = base.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col(name), mix.weights[depth], mix.other))
        nodes = nodes.withColumn("budget", F.lit(min(budget, total * mix.max_epochs)).cast("long")) if given is None else nodes.join(given, keys[:-1])
        given = _fill(nodes, keys[:-1], name).select(*keys, F.col("own").alias("budget"))
    return base.join(given.withColumnRenamed("budget", "leaf_budget"), list(LEVELS)).drop("cap")


def _digest(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _taken(mix: Mix) -> Column:
    """Copies of a row with `digest` and `n_tokens`, by its leaf's `full` and `cut`."""
    more = F.coalesce(F.struct("digest", "n_tokens") <= F.col("cut"), F.lit(False)) | F.col("all_fit")
    whole = (F.col("full") >= mix.max_epochs) | (F.col("rest") == 0)
    return F.when(whole, F.col("full")).otherwise(F.col("full") + more.cast("int")).cast("long")


def budgets(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """`docs` as rows (row, doc_id, domain, lang, source, n_tokens), and its leaves with their budget and what the prefix takes."""
    domain = numbered_domain(F.col("source")) if domain is None else domain
    tokens = estimated_tokens(F.col("text")) if tokens is None else tokens
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), blank(domain).alias("domain"), blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("source"), tokens.cast("long").alias("n_tokens"))
    slim = materialize(rows.drop("row"), "mix")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    leaves = allocate(materialize(leaves, "leaves"), mix)
    leaves = leaves.withColumn("full", F.when(F.col("tokens") > 0, F.expr("leaf_budget DIV tokens")).otherwise(F.lit(1))).withColumn("rest", F.when(F.col("tokens") > 0, F.col("leaf_budget") - F.col("full") * F.col("tokens")).otherwise(F.lit(0)))
    leaves = materialize(leaves.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / mix.bucket_rows)).cast("long")), "budgets")
    n_leaves = leaves.count()
    keyed = slim.join(bounded(leaves.select(*LEVELS, "full", "rest", "buckets"), n_leaves), list(LEVELS)).where("rest > 0").withColumn("digest", _digest(mix, F.col("full"), F.col("doc_id")))
    keyed = keyed.withColumn("bucket", F.expr("CAST(conv(substring(digest, 1, 8), 16, 10) AS BIGINT) * buckets DIV 4294967296"))
    # The bucket in which a leaf's prefix ends, and what is left for it.
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("sum"), F.max(F.struct("digest", "n_tokens")).alias("last"))
    upto = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    sums = materialize(sums.withColumn("upto", upto), "sums")
    ends = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("sum")).alias("room"))).alias("end"))
    before = sums.where("upto <= rest").groupBy(*LEVELS).agg(F.max("last").alias("earlier"))
    # In that bucket; equal digests and tokens have one running sum, as the frame is a range.
    edge = keyed.join(bounded(ends, n_leaves), list(LEVELS)).where("bucket = end.bucket")
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("digest", "n_tokens"))
    edge = edge.withColumn("run", run).where("run <= end.room").groupBy(*LEVELS).agg(F.max(F.struct("digest", "n_tokens")).alias("inside"))
    ended = ends.select(*LEVELS, F.lit(True).alias("ended"))
    leaves = leaves.join(before, list(LEVELS), "left").join(edge, list(LEVELS), "left").join(ended, list(LEVELS), "left")
    leaves = materialize(leaves.select(*LEVELS, "leaf_budget", "full", "rest", F.coalesce("inside", "earlier").alias("cut"), F.col("ended").isNull().alias("all_fit")), "cuts")
    for old in (slim, sums):
        discard(old)
    return rows, bounded(leaves, n_leaves)


def plan(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, leaf_budget, copies.

    `tokens`: a column of `docs` with the texts' token counts where they are known; else bytes are counted.
    """
    rows, leaves = budgets(docs, mix, domain, tokens)
    out = rows.drop("row").join(leaves, list(LEVELS)).withColumn("digest", _digest(mix, F.col("full"), F.col("doc_id")))
    return out.select("doc_id", *LEVELS, "n_tokens", "leaf_budget", _taken(mix).alias("copies"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Each row of `docs` as often as the mix takes it; its columns, in their order."""
    rows, leaves = budgets(docs, mix, domain, tokens)
    out = rows.join(leaves, list(LEVELS)).withColumn("digest", _digest(mix, F.col("full"), F.col("doc_id")))
    return out.withColumn("copies", _taken(mix)).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
