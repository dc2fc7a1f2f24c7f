"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression over style measures, fitted on a bounded sample of labelled training
rows) gives each document its own evidence.  Grouped sums give each host, and each path below a host, a posterior
share of good documents: a path shrinks toward its host, a host toward the corpus, with strengths estimated by
moments from how much sites of the same parent differ beyond chance.  A document's own evidence is left out of its
site's sums, and the two are combined in log-odds.

Defined results: null and empty texts have measures of 0 and are scored like any other; very long texts are measured
whole; null hosts and paths form a site of their own; a site with one document has its parent's posterior; without
labels of both kinds every document's own evidence is nearly that of the only label (0.5 without any label); ids with
both labels teach nothing; a null doc_id is passed through and never teaches; repeated rows get equal document scores;
extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import discard, join_skewed, labelled, materialize, sampled, small_batches
from kinweave.llm.token_counts import slices
from kinweave.llm.toxicity import fit_logistic

#: Labelled training rows of each label that are used at most.
MAX_TRAIN = 10_000
MEASURES = 12
KINDS = np.zeros((256, 6))
for _c in range(256):
    KINDS[_c] = [65 <= _c <= 90, _c in b"#*$%&<>", _c == 124, _c == 33, 48 <= _c <= 57, _c in b".,;:?"]


def measures(text: str | None) -> list[float]:
    """Style measures of a whole text, each between 0 and about 1."""
    if not text:
        return [0.0] * MEASURES
    raw = text.encode()
    words = text.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ KINDS
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        kinds[0] / size * 2,
        min(kinds[1] / n, 2) / 2,
        min(kinds[2] / n, 1),
        min(kinds[3] / n, 2) / 2,
        kinds[4] / size * 4,
        min(kinds[5] / n, 1),
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        min(size / n, 20) / 20,
        1 - len(set(lines)) / max(len(lines), 1),
        min(np.log1p(n) / 10, 1),
        float(n < 50),
    ]


@dataclass(frozen=True)
class Model:
    weights: list[float]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    rows = labelled(labels, label)
    chosen = sampled(rows.where("y = 1"), "doc_id", max_train).unionByName(sampled(rows.where("y = 0"), "doc_id", max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([measures(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    # Two integers for each of a bounded number of rows are broadcast; as many rows of measures come back.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y").mapInArrow(run, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in known], float)
    if not len(y) or y.min() == y.max():
        return Model([0.0] * MEASURES + [0.0 if not len(y) else 3.0 if y[0] else -3.0])
    return Model([float(w) for w in fit_logistic(np.array([r["x"] for r in known]), y, penalty=0.1)])


def document_scores(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, p (the document's own evidence)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        for b in batches:
            x = np.array([measures(t) for part in slices(b.column(3).cast(pa.large_string())) for t in part.to_pylist()], float).reshape(-1, MEASURES)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -12, 12)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p)], names=["doc_id", "host", "path", "p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
    return rows.mapInArrow(run, "doc_id bigint, host string, path string, p double")


def _strength(mean: float, within: float, between: float) -> float:
    """Pseudo-counts of a prior: the fewer, the more sites differ beyond what their sizes explain."""
    return float(np.clip(within / max(between, 1e-9), 1.0, 1e6))


def classify(docs: DataFrame, model: Model, host: Column, path: Column, sites: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_score, host_posterior, path_posterior, score, keep.

    `sites` (doc_id, host, path; an id once at most) says where documents are from, `host` and `path` for all others.
    """
    rows = document_scores(docs, model, host, path)
    if sites is not None:
        known = sites.select(F.col("doc_id").cast("long").alias("site_id"), F.col("host").alias("site_host"), F.col("path").alias("site_path"))
        rows = rows.join(known, F.col("doc_id") == F.col("site_id"), "left")
        at = F.col("site_id").isNotNull()
        rows = rows.select("doc_id", F.when(at, F.coalesce("site_host", F.lit(""))).otherwise(F.col("host")).alias("host"), F.when(at, F.coalesce("site_path", F.lit(""))).otherwise(F.col("path")).alias("path"), "p")
    rows = materialize(rows, "scores")
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n_p"), F.sum("p").alias("s_p"), F.sum(F.col("p") * F.col("p")).alias("q_p")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n_p").alias("n_h"), F.sum("s_p").alias("s_h"), F.sum("q_p").alias("q_h")), "hosts")
    total = hosts.agg(F.sum("n_h"), F.sum("s_h"), F.sum("q_h"), F.count("*")).first()
    n, mean = total[0] or 0, (total[1] / total[0] if total[0] else 0.5)

    def strengths(level: DataFrame, size: str, sum_: str, square: str, centre: Column) -> float:
        # Moments over sites with more than one document: the variance within sites and that of site means.
        own = level.where(F.col(size) > 1).select(F.col(size).alias("n"), (F.col(sum_) / F.col(size)).alias("m"), F.col(square).alias("q"), centre.alias("c"))
        r = own.agg(F.sum(F.col("q") - F.col("n") * F.col("m") ** 2), F.sum(F.col("n") - 1), F.avg((F.col("m") - F.col("c")) ** 2), F.avg(1 / F.col("n"))).first()
        if not r[1]:
            return 1e6
        within = max(r[0] / r[1], 1e-6)
        return _strength(mean, within, r[2] - within * r[3])

    k_h = strengths(hosts, "n_h", "s_h", "q_h", F.lit(mean))
    site = paths.join(hosts, "host")
    k_p = strengths(site, "n_p", "s_p", "q_p", F.col("s_h") / F.col("n_h"))
    posteriors = site.select("host", "path", "n_p", "s_p", "n_h", "s_h", F.col("n_p").alias("n"))
    out = join_skewed(rows, posteriors, ["host", "path"], "n")
    host_post = (F.col("s_h") - F.col("p") + k_h * mean) / (F.col("n_h") - 1 + k_h)
    out = out.withColumn("host_posterior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), host_post)))
    path_post = (F.col("s_p") - F.col("p") + k_p * F.col("host_posterior")) / (F.col("n_p") - 1 + k_p)
    out = out.withColumn("path_posterior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path_post)))
    logit = lambda c: F.log(c / (1 - c))
    base = float(np.clip(mean, 1e-6, 1 - 1e-6))
    z = logit(F.col("p")) + logit(F.col("path_posterior")) - float(np.log(base / (1 - base)))
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", F.col("p").alias("doc_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("keep"))


def site_of(url: Column, depth: int = 1) -> tuple[Column, Column]:
    """Host of a URL and the first `depth` parts of its path."""
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), F.array_join(F.slice(F.split(rest, "/"), 1, depth), "/")
