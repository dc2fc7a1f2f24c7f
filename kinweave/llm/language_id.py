"""Language identification with spans.

Script ranges narrow each word's candidate languages to those that use its script in training; word scores are
smoothed log-probabilities of the word's character n-grams (with a bonus from whole-word frequencies); Viterbi
with a penalty per switch labels every word, so mixed texts come out as spans.  The document's language is the
one whose spans hold most letters, and its score is that share.

A text for which no interval gains enough by leaving the best language keeps it throughout (exactly what Viterbi
would find); for the others Viterbi runs for all texts of a batch at once, word position by word position.
Each distinct word of a batch is scored once.

Defined results: `und` with score 0 for null texts and texts without a letter; ties go to the alphabetically first
language; with no training row at all every text is `und`; whole texts are labelled, also very long ones; a null doc_id
is never held out and never teaches; repeated rows get equal results; extra columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import is_train, small_batches
from kinweave.llm.token_counts import slices

#: Training rows of each language that are used at most.
MAX_TRAIN = 2_000
#: n-grams of each order, and words, of each language that the model keeps: the most frequent of the bounded sample.  It is
#: the size of the model, which every worker holds.
MAX_GRAMS = 8_000
ORDERS = (1, 2, 3, 4)
#: Log-probability a switch of language costs.
SWITCH = 6.0

#: First code points of script ranges, and their scripts.
RANGES = [(0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "other"), (0x20000, "Han"), (0x30000, "other")]
STARTS = [a for a, _ in RANGES]
#: What is no letter: a white-space token is scored, and learned, as its letters run together.
LETTERS = re.compile(r"[\W\d_]+")


def script_of(word: str) -> str:
    i = bisect_right(STARTS, ord(word[0])) - 1
    return RANGES[i][1] if i >= 0 else "other"


def grams(word: str) -> Iterator[str]:
    w = f"<{word}>"
    for n in ORDERS:
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    scripts: dict[str, list[int]]
    #: n-gram or `=word` -> log-probability for each language.
    table: dict[str, tuple[float, ...]]
    floor: list[tuple[float, ...]]


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn from training rows with a language; `max_train` rows of each at most, chosen by a hash of the id."""
    rows = docs.where(is_train(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, int(1_000_000 * max_train / n) + 1))]) if sizes else None
    if share is None:
        return Model([], {}, {}, [])
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1_000_000)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            by_lang: dict[str, Counter] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(w for x in t.lower().split() if (w := LETTERS.sub("", x)))
            for lang, words in by_lang.items():
                for w, n in words.items():
                    total[(lang, "@" + script_of(w))] += n
                    if len(w) <= 20:
                        total[(lang, "=" + w)] += n
                    for g in grams(w):
                        total[(lang, g)] += n
            if len(total) > 500_000:
                yield _frame(total)
                total = Counter()
        yield _frame(total)

    def _frame(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    from pyspark.sql import Window

    sums = chosen.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kind = F.when(F.col("gram").startswith("@"), "@").when(F.col("gram").startswith("=") & (F.length("gram") > 1), "=").otherwise(F.length("gram").cast("string"))
    sums = sums.withColumn("kind", kind)
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= MAX_GRAMS)
    langs = sorted(sizes)
    counts: dict[str, dict[str, dict[str, int]]] = {}
    for r in top.select("lang", "kind", "gram", "n").collect():
        counts.setdefault(r["kind"], {}).setdefault(r["lang"], {})[r["gram"]] = r["n"]
    scripts: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        own = counts.get("@", {}).get(lang, {})
        for s, n in own.items():
            if n >= 0.01 * sum(own.values()):
                scripts.setdefault(s[1:], []).append(k)
    table: dict[str, tuple[float, ...]] = {}
    floor = []
    for kind in [str(n) for n in ORDERS] + ["="]:
        by = counts.get(kind, {})
        total = [sum(by.get(lang, {}).values()) for lang in langs]
        low = tuple(math.log(0.5 / (t + 1.0)) for t in total)
        floor.append(low)
        for g in {g for c in by.values() for g in c}:
            table[g] = tuple(math.log((by.get(lang, {}).get(g, 0) + 0.5) / (t + 1.0)) for lang, t in zip(langs, total, strict=True))
    return Model(langs, scripts, table, floor)


def _keys(code: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n code points from each place."""
    k = np.full(max(len(code) - n + 1, 0), n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            k = (k ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
    return k


class Labeller:
    def __init__(self, model: Model, switch: float = SWITCH) -> None:
        self.m, self.switch = model, switch
        self.orders = []
        for n, low in zip(ORDERS[1:], model.floor[1:4], strict=False):
            own = [g for g in model.table if len(g) == n and not (g[0] == "=" and n > 1)]
            key = np.array([_keys(np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.uint64), n)[0] for g in own], np.uint64)
            order = np.argsort(key)
            rows = np.array([model.table[own[i]] for i in order] + [low], np.float32) / n
            self.orders.append((n, np.append(key[order], np.uint64(2**64 - 1)), rows))
        whole = [g for g in model.table if g[0] == "=" and len(g) > 1]
        self.whole = pa.array([g[1:] for g in whole], pa.large_string())
        if model.langs:
            self.whole_rows = np.array([model.table[g] for g in whole] + [model.floor[4]], np.float32) * 0.5
        #: For each script range: what is added to languages that don't use its script.
        self.shut = np.zeros((len(RANGES) + 1, len(model.langs)), np.float32)
        for i, (_, script) in enumerate(RANGES):
            some = model.scripts.get(script)
            if some:
                self.shut[i + 1] = -1000
                self.shut[i + 1, some] = 0

    def score_words(self, words: pa.Array) -> np.ndarray:
        """Log-likelihoods of words (letters only) by language, relative to the best candidate; 0 for empty ones."""
        out = np.zeros((len(words), len(self.m.langs)), np.float32)
        some = np.flatnonzero(pc.greater(pc.utf8_length(words), 0).to_numpy(zero_copy_only=False))
        if not len(some):
            return out
        text = [f"<{w}>" for w in words.take(pa.array(some)).to_pylist()]
        code = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, text), np.int64, len(text))
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(code))  # code points up to the word's end
        v = np.zeros((len(text), len(self.m.langs)), np.float64)
        for n, key, rows in self.orders:
            mine = _keys(code, n)
            at = np.searchsorted(key[:-1], mine)
            row = np.where((key[at] == mine) & (at < len(key) - 1), at, len(rows) - 1)
            got = np.zeros((len(code), rows.shape[1]), np.float32)
            got[: len(mine)] = rows[row]
            got[left < n] = 0
            v += np.add.reduceat(got, begin, axis=0)
        at = pc.fill_null(pc.index_in(words.take(pa.array(some)), value_set=self.whole), len(self.whole)).to_numpy()
        v += self.whole_rows[at]
        v += self.shut[np.searchsorted(STARTS, code[begin + 1], "right")]
        out[some] = np.maximum(v - v.max(1, keepdims=True), -12.0)
        return out

    def paths(self, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Viterbi labels of the tokens with these scores; text i has the tokens at[i] to at[i + 1]."""
        n, k = np.diff(at), score.shape[1]
        label = np.zeros(len(score), np.int32)
        if not len(score) or k == 1:
            return label
        # The best single language holds throughout when no interval gains more by leaving it than one switch costs.
        doc = np.repeat(np.arange(len(n)), n)
        some = np.flatnonzero(n)
        total = np.zeros((len(n), k))
        total[some] = np.add.reduceat(score, at[:-1][some], axis=0, dtype=np.float64)
        main = total.argmax(1).astype(np.int32)
        label[:] = main[doc]
        own = np.take_along_axis(score, label[:, None].astype(np.int64), 1)[:, 0]
        other = np.full(len(score), -np.inf, np.float32)
        for j in range(k):
            other = np.where(label == j, other, np.maximum(other, score[:, j]))
        gain = np.cumsum(other - own, dtype=np.float64)
        before = np.concatenate([[0.0], gain[:-1]])
        shift = doc * (2 * (np.abs(gain).max() + 1))
        most = np.zeros(len(n))
        most[some] = np.maximum.reduceat(gain - shift - np.minimum.accumulate(before - shift), at[:-1][some])
        mixed = np.flatnonzero(most > self.switch)
        if len(mixed):
            self._viterbi(score, at[:-1][mixed], n[mixed], label)
        return label

    def _viterbi(self, score: np.ndarray, begin: np.ndarray, n: np.ndarray, label: np.ndarray) -> None:
        order = np.argsort(-n, kind="stable")
        begin, n, k = begin[order], n[order], score.shape[1]
        active = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts with more than t tokens
        stay, come = np.zeros((len(score), k), bool), np.zeros(len(score), np.int32)
        v, cost = np.zeros((len(n), k), np.float64), float(self.switch)
        for t in range(n[0]):
            a = active[t]
            here, x = begin[:a] + t, v[:a]
            best = x.argmax(1)
            top = x.max(1, keepdims=True) - cost
            stay[here], come[here] = x >= top, best
            v[:a] = np.maximum(x, top) + score[here]
        last = v.argmax(1)
        for t in range(n[0] - 1, -1, -1):
            a = active[t]
            here = begin[:a] + t
            label[here] = last[:a]
            last[:a] = np.where(stay[here, last[:a]], last[:a], come[here])

    def _tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and letters of each white-space token, and where each text's tokens begin and end."""
        words = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        at = words.offsets.to_numpy()
        coded = words.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        # Only the letters of a token are scored.
        bare = pc.replace_substring_regex(coded.dictionary, r"[^\pL]+", "").dictionary_encode()
        score = self.score_words(bare.dictionary)
        letters = pc.utf8_length(bare.dictionary).to_numpy()
        code = bare.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        return score[code], letters[code], (at - at[0]).astype(np.int64)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of the letters, and the number of spans of each text."""
        names, out_lang, out_score, out_spans = self.m.langs, [], [], []
        for part in slices(texts, 4096, 16_000_000):
            if not names:
                out_lang += ["und"] * len(part)
                out_score.append(np.zeros(len(part)))
                out_spans.append(np.zeros(len(part), np.int64))
                continue
            score, letters, at = self._tokens(part)
            label = self.paths(score, at)
            doc = np.repeat(np.arange(len(part)), np.diff(at))
            share = np.bincount(doc * len(names) + label, letters, len(part) * len(names)).reshape(len(part), -1)
            total, best = share.sum(1), share.argmax(1)
            # A span ends where the label changes inside a text.
            cut = np.append(np.flatnonzero((np.diff(label) != 0) & (np.diff(doc) == 0)), []).astype(np.int64)
            out_spans.append((np.diff(at) > 0) + np.bincount(doc[cut], minlength=len(part)))
            out_lang += [names[b] if s else "und" for b, s in zip(best, total, strict=True)]
            out_score.append(np.where(total > 0, share[np.arange(len(part)), best] / np.maximum(total, 1), 0.0))
        return out_lang, np.concatenate([np.zeros(0), *out_score]), np.concatenate([np.zeros(0, np.int64), *out_spans])

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (first word, one past the last, language) of one text."""
        if not self.m.langs:
            return []
        score, _, at = self._tokens(pa.array([text], pa.large_string()))
        if not len(score):
            return []
        label = self.paths(score, at)
        cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
        return [(a, b, self.m.langs[label[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans (spans of one language; 0 for texts without a word)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches:
            lang, score, spans = labeller.predict(b.column(1).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int64())], names=["doc_id", "lang_pred", "score", "n_spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, n_spans bigint")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


def mixed_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_word, end_word, lang: the spans of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for b in batches:
            rows = [(d, *s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for s in labeller.spans(t)]
            kinds = {"doc_id": pa.int64(), "first_word": pa.int64(), "end_word": pa.int64(), "lang": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, first_word long, end_word long, lang string")
