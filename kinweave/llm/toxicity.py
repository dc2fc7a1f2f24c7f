"""Toxicity by fuzzy lexicon matching in context.

A lexicon (whole words, and stems that stand for all their continuations) is learned from labelled training rows;
a term counts once for each pair of words it is seen between at some distance, so that the words of a text with
many copies don't pass for terms.  A near form of a term that clean training rows use as a word of its own is no misspelling.
Tokens are matched by the intersection of Levenshtein automata with the lexicon's trie: an automaton state is the
set of (trie node, edits so far) that a token's prefix can reach; states are made deterministic on first use, so a
token costs one table look-up per character and most tokens die after a few.  A match is scored in a window of
tokens around it: quotation marks and reporting verbs lower it, direct address and further matches raise it.  How much
is chosen among a few settings by a split inside the training rows; a logistic model over the window scores, fitted on
all training rows then, gives the probability.

Defined results: null and empty texts have no match and get the score of a text without matches; very long texts
are read whole; repeated rows get equal scores; null doc_ids are never held out and never trained on; ids with both
labels teach nothing; without labels of both kinds the lexicon is empty and every score is nearly that of the only
label (0 without any); extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import labelled, sampled, small_batches
from kinweave.llm.token_counts import slices

#: Labelled training rows of each label that are used at most (their ids are broadcast, 8 bytes each).  The sample's
#: vocabulary, which comes to the driver, is bounded by it.
MAX_TRAIN = 10_000
#: Words from a term to those that tell one place of it from another; fixed phrases up to this long are no hindrance.
APART = 4
#: What a match is worth for each misspelling in it.
MISSPELT = 0.8
#: What it is worth inside quotation marks, near a reporting word, near a word that addresses someone, and near another
#: match: the settings to choose from.
SETTINGS = ((0.4, 0.6, 1.3, 1.2), (1.0, 1.0, 1.0, 1.0), (0.2, 0.4, 1.5, 1.3), (0.6, 0.8, 1.15, 1.1), (0.4, 1.0, 1.3, 1.2))
#: Another setting than the first is taken if it lowers the loss on the inner split by so much.
CLEARLY = 0.002
STEM_LENGTHS = (4, 5, 6)
WINDOW = 6
#: Tokens whose matches a worker remembers; at this number it starts anew.
REMEMBERED = 400_000

LEET = str.maketrans("0134578@$!", "oieastbasi")
WORDS = re.compile(r"[^\W\d_]{3,}")
EDGES = re.compile(r"^[^\w@$]+|[^\w@$!]+$|!+$")
OPEN = "\"'“‘«„‹"
CLOSE = "\"'”’»“›"
REPORTING = frozenset(
    "said says say called calls calling wrote writes word words term terms quote quoted quotes quoting comment reported reports insult insults slur slurs"
    " dit dire écrit mot terme citation appelé sagte sagt schrieb wort begriff zitat nannte dijo dice escribió palabra término cita llamó".split()
)
ADDRESS = frozenset("you your you're youre ur u yourself tu toi ton vous votre du dich dein deine ihr sie tú usted ustedes te".split())


def terms_of(text: str) -> set[str]:
    """Distinct words of a text, and the stems they start with (marked by `*`)."""
    return {t for w in set(WORDS.findall(text.lower())) for t in forms(w)}


def forms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEM_LENGTHS if len(word) > k)]


def choose_terms(stats: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms whose association with the label is beyond chance over all terms tried, with their log-odds."""
    if not n_toxic or not n_clean:
        return {}
    base, need = n_toxic / (n_toxic + n_clean), math.log(max(len(stats), 10_000)) + 3
    found: dict[str, float] = {}
    for term, a, b in stats:
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        share = a / (a + b)
        if share <= base or odds < math.log(20):
            continue
        gain = a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0)
        if gain > need:
            found[term] = odds
    # A stem replaces the longer stems below it; words stay beside it, as only they are matched with misspellings.
    stems = sorted((t[:-1] for t in found if t.endswith("*")), key=len)
    counts = {t: a for t, a, _ in stats if t in found}
    kept: dict[str, float] = {}
    for s in stems:
        if not any(s.startswith(k[:-1]) for k in kept):
            below = [a for t, a in counts.items() if not t.endswith("*") and t.startswith(s)]
            # One word alone is that word, not a stem.
            if not below or max(below) < 0.9 * counts[s + "*"]:
                # The longest stem that says as much.
                best = max((t for t in stems if t.startswith(s) and counts[t + "*"] >= 0.9 * counts[s + "*"]), key=len)
                kept[best + "*"] = found[best + "*"]
    for t, odds in found.items():
        if not t.endswith("*"):
            kept[t] = odds
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


def edits_allowed(term: str) -> int:
    """Misspellings that count (a swap of neighbours is one): none in stems and short words, one from four letters, two from eight."""
    return 0 if term.endswith("*") or len(term) < 4 else 1 if len(term) < 8 else 2


@dataclass
class Matcher:
    """The lexicon's trie intersected with Levenshtein automata, made deterministic on demand."""

    lexicon: dict[str, float]
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[tuple[str, int] | None] = field(default_factory=lambda: [None])
    most: list[int] = field(default_factory=lambda: [0])
    stem: list[bool] = field(default_factory=lambda: [False])

    def __post_init__(self) -> None:
        for term in self.lexicon:
            node, k = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], k)
            for c in term.removesuffix("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.most.append(0)
                    self.stem.append(False)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node] = (term, k)
            self.stem[node] = term.endswith("*")
        self._forget()

    def _forget(self) -> None:
        start = self._closed({(0, 0, "")})
        # Deterministic states by number: what they stand for, their moves (-1: none), their best match.
        self.number: dict[frozenset, int] = {start: 0}
        self.states: list[frozenset] = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int] | None] = [self._match_of(start)]

    def _match_of(self, state: frozenset) -> tuple[float, int] | None:
        found = [(e, -self.lexicon[self.ends[n][0]]) for n, e, due in state if not due and self.ends[n] is not None and e <= self.ends[n][1]]
        if not found:
            return None
        e, w = min(found)
        return -w, e

    def _move(self, number: int, c: str) -> int:
        after = self._after(self.states[number], c)
        to = -1
        if after:
            to = self.number.setdefault(after, len(self.states))
            if to == len(self.states):
                self.states.append(after)
                self.moves.append({})
                self.best.append(self._match_of(after))
        self.moves[number][c] = to
        return to

    def _closed(self, states: set[tuple[int, int, str]]) -> frozenset:
        """With letters of the term left out; of equal states the one of fewest edits stays."""
        best: dict[tuple[int, str], int] = {}
        todo = list(states)
        while todo:
            node, e, due = todo.pop()
            if best.get((node, due), 9) <= e:
                continue
            best[node, due] = e
            if not due:
                todo += [(n, e + 1, "") for n in self.next[node].values() if e < self.most[n]]
        return frozenset((node, e, due) for (node, due), e in best.items())

    def _after(self, state: frozenset, c: str) -> frozenset:
        to: set[tuple[int, int, str]] = set()
        for node, e, due in state:
            if due:  # the second letter of a swap
                if c == due:
                    to.add((node, e, ""))
                continue
            if self.stem[node] and e == 0:
                to.add((node, 0, ""))
            for d, n in self.next[node].items():
                if d == c:
                    to.add((n, e, ""))
                elif e < self.most[n]:
                    to.add((n, e + 1, ""))
                    if c in self.next[n] and e < self.most[self.next[n][c]]:
                        to.add((self.next[n][c], e + 1, d))
            if e < self.most[node]:
                to.add((node, e + 1, ""))
        return self._closed(to)

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and number of edits of the best match."""
        if len(self.states) > 50_000:
            self._forget()
        at, moves = 0, self.moves
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = self._move(at, c)
            if to < 0:
                return None
            at = to
        return self.best[at]


FEATURES = 2


class Scorer:
    """Features of a text: window scores of matches, summed and at most.

    `other_words`: words near a term that are no misspellings of it.
    """

    def __init__(self, lexicon: dict[str, float], other_words: frozenset[str] = frozenset(), setting: tuple[float, ...] = SETTINGS[0]) -> None:
        self.matcher, self.setting = Matcher(lexicon), setting
        self.other_words = other_words
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def _look(self, token: str) -> tuple[float, int] | None:
        found = self._nearest(token)
        return None if found and found[1] and EDGES.sub("", token) in self.other_words else found

    def _nearest(self, token: str) -> tuple[float, int] | None:
        if token.isalpha():
            return self.matcher.match(token)
        word = EDGES.sub("", token)
        found = self.matcher.match(word) if word else None
        plain = word if word.isalpha() else word.translate(LEET)
        if plain != word and not (found and found[1] == 0) and not word.isdigit():
            again = self.matcher.match(plain)
            if again and (found is None or again[1] < found[1]):
                found = (again[0], again[1] + 1)
        return found

    def matches(self, text: str | None) -> tuple[list[str], list[int]]:
        """The text's tokens, and the places of those that match."""
        if not text or not self.matcher.lexicon:
            return [], []
        tokens = text.lower().split()
        distinct = set(tokens)
        new = distinct - self.seen
        if new:
            if len(self.seen) + len(new) > REMEMBERED:
                self.seen.clear()
                self.hits.clear()
                new = distinct
            self.seen |= new
            for t in new:
                if (m := self._look(t)) is not None:
                    self.hits[t] = m
        if self.hits.keys().isdisjoint(distinct):
            return tokens, []
        return tokens, [i for i, t in enumerate(tokens) if t in self.hits]

    def windows(self, text: str | None) -> list[tuple[float, tuple[bool, bool, bool, bool]]]:
        """For each match what it is worth by itself, and whether it is quoted, reported, addressed, among others."""
        tokens, at = self.matches(text)
        out, places = [], set(at)
        for i in at:
            weight, edits = self.hits[tokens[i]]
            bare = {EDGES.sub("", t) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
            near = any(j in places for j in range(i - WINDOW, i + WINDOW + 1) if j != i)
            out.append((min(weight, 8.0) / 8.0 * MISSPELT**edits, (self._quoted(tokens, i), bool(bare & REPORTING), bool(bare & ADDRESS), near)))
        return out

    @staticmethod
    def summed(windows: list, setting: tuple[float, ...]) -> list[float]:
        scores = [math.prod((w, *(f for f, on in zip(setting, flags, strict=True) if on))) for w, flags in windows]
        return [math.log1p(sum(scores)), max(scores, default=0.0)]

    def features(self, text: str | None) -> list[float]:
        return self.summed(self.windows(text), self.setting)

    @staticmethod
    def _quoted(tokens: list[str], i: int) -> bool:
        """Inside quotation marks that open at most a window before and close at most a window after."""
        opened = any(t[0] in OPEN for t in tokens[max(0, i - WINDOW) : i + 1])
        return opened and any(t.rstrip(".,;:!?")[-1:] in CLOSE and t.rstrip(".,;:!?") for t in tokens[i : i + WINDOW + 1])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept's."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: list[float]
    other_words: frozenset[str] = frozenset()
    setting: tuple[float, ...] = SETTINGS[0]


def _weights(x: np.ndarray, y: np.ndarray, setting: tuple[float, ...]) -> np.ndarray:
    """A logistic model; toxic rows also count as if each match were misspelt and stood alone, as few labelled rows are."""
    more, less = x[y == 1], MISSPELT / setting[2] / setting[3]
    more = np.stack([np.log1p(np.expm1(more[:, 0]) * less), more[:, 1] * less], axis=1)
    return fit_logistic(np.vstack([x, more]), np.concatenate([y, np.ones(len(more))]), penalty=0.1)


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(x @ w[:-1] + w[-1], -30, 30)
    return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))


def choose_setting(x: np.ndarray, y: np.ndarray, inner: np.ndarray) -> int:
    """The setting whose model, fitted on the rows outside `inner`, has the least loss on those inside."""
    if len(set(y[inner])) < 2 or len(set(y[~inner])) < 2:
        return 0
    losses = [_loss(x[inner, k], y[inner], _weights(x[~inner, k], y[~inner], s)) for k, s in enumerate(SETTINGS)]
    best = int(np.argmin(losses))
    return best if losses[best] < losses[0] - CLEARLY else 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn lexicon and model from training rows: `max_train` of each label at most, chosen by a hash of the id."""
    small_batches(docs.sparkSession)
    rows = labelled(labels, label)
    chosen = sampled(rows.where("y = 1"), "doc_id", max_train).unionByName(sampled(rows.where("y = 0"), "doc_id", max_train))
    # Two integers for each of a bounded number of rows.
    train = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "y", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("inner"))
    train = train.persist()
    try:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            toxic: Counter = Counter()
            clean: Counter = Counter()
            for b in batches:
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    (toxic if y else clean).update(terms_of(t))
                if len(toxic) + len(clean) > 300_000:
                    yield _rows(toxic, clean)
                    toxic, clean = Counter(), Counter()
            yield _rows(toxic, clean)

        def _rows(toxic: Counter, clean: Counter) -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["term", "a", "b"])

        sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        if not n1 or not n0:
            share = 0.0 if not n1 else 1.0
            return Model({}, [0.0] * FEATURES + [8.0 if share else -8.0])
        stats = train.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        # Terms of the bounded sample that lean strongly to the label; chance ones have few rows and stay away.
        lean = frozenset(r["term"] for r in stats.where((F.col("a") >= 4) & (F.col("a") * n0 > 10 * F.col("b") * n1)).select("term").collect())

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = set()
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = WORDS.findall(t.lower())
                    around = [""] * APART + words + [""] * APART
                    for before, word, after in zip(around, words, around[2 * APART :], strict=False):
                        rows.update((term, y, f"{before} {after}") for term in forms(word) if term in lean)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], names=["term", "y", "place"])

        places = train.mapInArrow(between, "term string, y int, place string").distinct().groupBy("term").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
        lexicon = choose_terms([(r["term"], r["a"], r["b"]) for r in places.collect()], n1, n0)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(lexicon)
            for b in batches:
                rows = []
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    tokens, at = scorer.matches(t)
                    rows += [(w, y) for w in {EDGES.sub("", tokens[i]) for i in at if scorer.hits[tokens[i]][1]}]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32()))], names=["word", "y"])

        # Near forms of the bounded sample that are no rarer in clean rows than in others.
        forms_seen = train.mapInArrow(near, "word string, y int").groupBy("word").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
        other_words = frozenset(r["word"] for r in forms_seen.where(F.col("b") * n1 * 5 >= F.col("a") * n0).select("word").collect())

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(lexicon, other_words)
            for b in batches:
                seen = [scorer.windows(t) for t in b.column(0).to_pylist()]
                x = pa.array([[v for s in SETTINGS for v in scorer.summed(w, s)] for w in seen], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), x], names=["y", "inner", "x"])

        # A row of a few numbers for each of the bounded number of training rows.
        known = train.mapInArrow(features, "y int, inner boolean, x array<double>").collect()
        x = np.array([r["x"] for r in known], float).reshape(len(known), len(SETTINGS), FEATURES)
        y, inner = np.array([r["y"] for r in known], float), np.array([r["inner"] for r in known], bool)
        k = choose_setting(x, y, inner)
        return Model(lexicon, [float(v) for v in _weights(x[:, k], y, SETTINGS[k])], other_words, SETTINGS[k])
    finally:
        train.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = Scorer(model.lexicon, model.other_words, model.setting), np.array(model.weights)
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            x = np.array([scorer.features(t) for part in slices(texts) for t in part.to_pylist()], float).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
