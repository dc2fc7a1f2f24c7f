"""Each operator on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from kinweave.llm import exact_dedup, language_id, mixing, passage_dedup, quality_classifier, quality_rules, sentencepiece_bpe, simhash, token_counts, toxicity  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, cell string, copies long"
rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "Omega", "house", "river", "stone", "été", "naïve"]
LONG = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(30_000))


def texts():
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 120))) + "." for _ in range(40)]
    return base + base[:8] + [base[3] + " "] + [None, "", " \n\t", None, "a", "A b", "x  y\nz", LONG, base[9].replace(" ", "  ", 3)]


@pytest.fixture(scope="module")
def rows():
    return [(i if i != 45 else None, t, ["en", "fr", None][i % 3], ["src1", "src2", "src1", None][i % 4], len(t or ""), "w", "c", 9) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, rows, empty):
    out = exact_dedup.dedup(docs).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), 2**63 if d is None else d, d))
    assert len(out) == len(rows)
    by = {r["text_sha256"]: r for r in out if r["kept"]}
    assert len(by) == len(groups) and sum(r["kept"] for r in out) == len(groups)
    for norm, members in groups.items():
        r = by[hashlib.sha256(norm.encode()).hexdigest()]
        assert r["keep_id"] == min(members)[2] and r["group_size"] == len(members)
    assert exact_dedup.dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(docs.unionByName(docs))
    assert kept.columns == docs.columns and kept.count() == len(groups)


def weak(norm):
    """A digest that only tells lengths apart."""
    return F.char_length(norm).cast("string")


def test_texts_with_one_digest_are_told_apart(spark, docs, rows):
    from kinweave.llm.common import new_path

    groups = Counter(re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows)
    out = exact_dedup.dedup(docs, digest=weak).collect()
    assert sum(r["kept"] for r in out) == len(groups) and sorted(r["group_size"] for r in out) == sorted(n for n in groups.values() for _ in range(n))
    # Across runs too, by the text that the state's locator leads to.
    state = new_path(spark, "test")
    first = spark.createDataFrame([(1, "abc"), (2, "wxyz")], "doc_id long, text string")
    assert exact_dedup.dedup(first, state, weak).where("kept").count() == 2
    second = spark.createDataFrame([(3, "x y z"), (None, "w x y z")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in exact_dedup.dedup(second, state, weak).collect()}
    assert out[1]["group_size"] == 1 and out[3]["group_size"] == 1 and out[1]["kept"] and out[3]["kept"]
    assert out[2]["group_size"] == 2 and [out[2]["kept"], out[None]["kept"]] == [False, True] and out[2]["keep_id"] is None


def test_null_ids_across_runs(spark):
    from kinweave.llm.common import new_path

    one = spark.createDataFrame([(None, "same text")], "doc_id long, text string")
    state = new_path(spark, "test")
    exact_dedup.dedup(one, state).collect()
    out = exact_dedup.dedup(one, state).collect()
    assert [r["group_size"] for r in out] == [2, 2] and sum(r["kept"] for r in out) == 1
    many = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b"), (4, "a")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_copies(many).collect()) == [(0, "b"), (4, "a")]


def test_dedup_state_continues(spark, docs):
    from kinweave.llm.common import new_path

    state = new_path(spark, "test")
    first = exact_dedup.dedup(docs.where("doc_id < 20"), state)
    assert first.count() == 20
    assert exact_dedup.dedup(docs.where("doc_id >= 20"), state).where("group_size > 1").count() == exact_dedup.dedup(docs.where("doc_id is not null")).where("group_size > 1").count()


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = {r["doc_id"]: r for r in token_counts.token_counts(docs, path).collect()}
    for d, text, *_ in rows:
        assert out[d]["n_tokens"] == len(t.encode(text or "", add_special_tokens=False)) and out[d]["n_bytes"] == len((text or "").encode())
    assert out[rows[-2][0]]["over_limit"] and token_counts.token_counts(empty, path).count() == 0
    clash = docs.withColumns({"row": F.lit(1), "word": F.lit("x"), "others": F.lit(2)})
    twice = token_counts.token_counts(clash.unionByName(clash), path)
    assert twice.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(r["n_tokens"] for r in twice.collect()) == sorted(2 * [r["n_tokens"] for r in out.values()])


@pytest.mark.parametrize("head", [0, 3])
def test_token_counts_by_the_join(spark, docs, rows, head, monkeypatch):
    """With few or no frequent pre-tokens, the shuffled join counts the others."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "HEAD_WORDS", head)
    own = random.Random(1)
    odd = ["".join(own.choice("aB1 é\n\t\u00a0<|endoftext|>!'_日\u2028\x1c") for _ in range(own.randrange(40))) for _ in range(400)] + ["<|endoftext|> x <|startoftext|>y"]
    d = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id > 1000000"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(d, path).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in enumerate(odd)}


def test_tokenizers_with_white_space_are_refused(docs):
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_quality_rules(docs, rows, empty):
    out = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for d, text, *_ in rows:
        w = [x for x in re.split(r"[ \t-\r]+", text or "") if x]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (out[d]["n_words"], out[d]["n_repeat_words"], out[d]["word_chars"]) == (len(w), len(rep), sum(map(len, w)))
        assert out[d]["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    cleaned = quality_rules.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == sum(r["kept"] for r in out.values())
    assert quality_rules.judge(empty).count() == 0


def test_lines_are_cleaned(spark):
    good = " ".join(["Plain words make a sentence."] * 1 + [f"word{i}" for i in range(80)]) + "."
    bad = "Home | About | Contact | News"
    r = quality_rules.judge(spark.createDataFrame([(1, good + "\n" + bad), (2, (bad + "\n") * 30 + good)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0]["kept"] and r[0]["clean_text"] == good and not r[1]["kept"]


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, rows, empty):
    out = {r["doc_id"]: r for r in simhash.dedup(docs).collect()}
    fps = {d: brute_fingerprint(t) for d, t, *_ in rows}
    assert {d: r["fp"] & (2**64 - 1) for d, r in out.items()} == fps
    want = brute_components({9**9 if d is None else d: f for d, f in fps.items()})
    assert {9**9 if d is None else d: r["component_id"] for d, r in out.items()} == want
    assert simhash.dedup(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    # One row of each component stays, also of repeated rows and of rows without a doc_id.
    again = docs.unionByName(docs).unionByName(docs.where("doc_id is null"))
    kept = simhash.drop_near_copies(again)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values()))
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "quite another text")], "doc_id long, text string")
    assert simhash.drop_near_copies(nulls).count() == 2


def test_embedding_bounds_the_distance(spark):
    own = random.Random(3)
    pairs = []
    for _ in range(300):
        u = own.getrandbits(64)
        v = u
        for _ in range(own.randrange(5)):
            v ^= 1 << own.randrange(64)
        pairs.append((u - (1 << 64) if u >> 63 else u, v - (1 << 64) if v >> 63 else v))
    pairs += [(0, -1), (-1, -1), (-(1 << 63), 0)]
    d = spark.createDataFrame(pairs, "u long, v long").select("u", "v", simhash.embed(F.col("u")).alias("pu"), simhash.embed(F.col("v")).alias("pv"))
    d = d.withColumn("shared", F.arrays_overlap(simhash._cells(F.col("pu")), simhash._cells(F.col("pv"))))
    for r in d.collect():
        seg = [[bin((x & (2**64 - 1)) >> k & 15).count("1") for k in range(0, 64, 4)] for x in (r["u"], r["v"])]
        assert [r["pu"] >> k & 15 for k in range(0, 64, 4)] == seg[0]
        manhattan = sum(abs(a - b) for a, b in zip(*seg, strict=True))
        assert manhattan <= ((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() and r["shared"] == (manhattan <= 2)


def test_links_keep_components(spark):
    from kinweave.llm.common import components

    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 1, 2**64 - 1, 2**63}
    for f in list(fps)[:20]:
        for _ in range(15):
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    # A full ball around one value: a cell with very many fingerprints.
    fps |= {0x1234567 ^ 1 << i ^ 1 << j for i in range(20) for j in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    by = brute_components({i: f & (2**64 - 1) for i, f in enumerate(signed)})
    ours, theirs = defaultdict(set), defaultdict(set)
    for i, f in enumerate(signed):
        ours[got.get(f, f)].add(i)
        theirs[by[i]].add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def sequential_mix(rows, mix):
    """The same by plain loops: budgets by filling siblings in turn, prefixes document by document."""
    import math

    def fill(children, budget):
        own, left, open_ = {}, budget, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
        while open_:
            name, cap, w = open_[0]
            weight = sum(c[2] for c in open_)
            if left * w <= cap * weight:
                return own | {c[0]: min(c[1], left * c[2] // weight) for c in open_}
            own[name], left, open_ = cap, left - cap, open_[1:]
        return own

    docs = []
    for i, (d, text, lang, source, *_) in enumerate(rows):
        n = re.search(r"([0-9]{1,9})$", source or "")
        docs.append((i, d, f"domain{int(n[1]) % 4}" if n else "other", lang or "", source or "", math.ceil(len((text or "").encode()) / 4)))
    tokens = Counter()
    for _, _, *leaf, n in docs:
        for k in range(4):
            tokens[tuple(leaf[:k])] += n
    budget = {(): min(tokens[()] * mix.share[0] // mix.share[1], tokens[()] * mix.max_epochs)}
    for depth in range(3):
        for parent in [k for k in tokens if len(k) == depth]:
            kids = [k for k in tokens if len(k) == depth + 1 and k[:depth] == parent]
            budget |= {parent + (name,): b for name, b in fill([(k[-1], tokens[k] * mix.max_epochs, mix.weights[depth].get(k[-1], mix.other)) for k in kids], budget[parent]).items()}
    out = {}
    for leaf in [k for k in tokens if len(k) == 3]:
        own = [x for x in docs if x[2:5] == leaf]
        full = budget[leaf] // tokens[leaf] if tokens[leaf] else 1
        rest = budget[leaf] - full * tokens[leaf] if tokens[leaf] else 0
        groups = defaultdict(list)
        for i, d, *_, n in own:
            groups[hashlib.md5(f"{mix.seed}|{full}|{'null' if d is None else d}".encode()).hexdigest(), n].append(i)
        used, more = 0, full < mix.max_epochs and rest > 0
        for (_, n), ids in sorted(groups.items()):
            used += n * len(ids)
            more = more and used <= rest
            out |= dict.fromkeys(ids, full + more)
    return out


@pytest.mark.parametrize("share", [(3, 5), (11, 10), (1, 9)])
def test_mixing_against_a_sequential_pass(spark, docs, rows, share):
    own = random.Random(2)
    some = [(own.choice([None, *range(200)]), " ".join(["w"] * own.randrange(40)), own.choice(["en", "fr", "de", None]), own.choice(["s1", "s2", "s3", "x", None]), 0, "w", "c", 1) for _ in range(300)]
    for table in (rows + rows[:7], some):
        mix = mixing.Mix(share=share, bucket_rows=10)
        d = spark.createDataFrame(table, DOCS)
        want = sequential_mix(table, mix)
        key = lambda i: (table[i][0], table[i][2] or "", table[i][3] or "", len((table[i][1] or "").encode()))
        got = Counter(((r["doc_id"], r["lang"], r["source"], r["n_tokens"]), r["copies"]) for r in mixing.plan(d, mix).collect())
        assert got == Counter(((*key(i)[:3], -(-key(i)[3] // 4)), n) for i, n in want.items())
        taken = mixing.mix_documents(d.withColumn("__k", F.lit(5)).withColumn("__copies", F.lit(6)).withColumn("row", F.lit(7)), mix)
        assert taken.columns == [*d.columns, "__k", "__copies", "row"]
        assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in taken.collect()) == sum((Counter({(table[i][0], table[i][1], table[i][2], table[i][3]): n}) for i, n in want.items() if n), Counter())


def test_mixing(docs, empty, spark):
    out = mixing.plan(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["copies"] <= 2 for r in out)
    spent = defaultdict(int)
    for r in out:
        spent[r["domain"], r["lang"], r["source"], r["leaf_budget"]] += r["copies"] * r["n_tokens"]
    assert all(n <= k[3] for k, n in spent.items())
    assert mixing.plan(empty).count() == 0
    leaves = spark.createDataFrame([("domain0", "en", "a", 100, 1), ("domain0", "en", "b", 1000, 1), ("domain1", "en", "c", 5000, 1)], "domain string, lang string, source string, tokens long, n_docs long")
    got = {r["source"]: r["leaf_budget"] for r in mixing.allocate(leaves, mixing.Mix(budget=1400, max_epochs=1)).collect()}
    # domain0 is due 800: a's shortage goes to its sibling first.
    assert got == {"a": 100, "b": 700, "c": 600}
    assert mixing.mix_documents(docs).columns == docs.columns


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = sentencepiece_bpe.encode(docs, path)
    out = {r["doc_id"]: r for r in enc.collect()}
    for d, text, *_ in rows:
        assert out[d]["ids"] == sp.encode(text or "") and out[d]["round_trip"] and out[d]["n_pieces"] == len(out[d]["ids"])
    odd = ["a\0b \0 c\0\0", "\0", "\1 x\0", "".join(sentencepiece_bpe.MARKS) + " all  marks", " ".join(f"w{i}\0" for i in range(3000))]
    got = sentencepiece_bpe.encode(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [sp.encode(t) for t in odd]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_bpe.decode(enc, path).collect()}
    assert all(back[d] == (t or "") for d, t, *_ in rows)
    assert sentencepiece_bpe.encode(empty, path).count() == 0


def test_language(spark, docs, empty):
    rows = [(i, ("the house and the river " if i % 2 else "la maison et la rivière ") * 20, "en" if i % 2 else "fr") for i in range(60)] + [(60, None, "en"), (61, "123 !", "fr"), (62, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(d)
    out = {r["doc_id"]: r for r in language_id.identify(d, m).collect()}
    assert all(out[i]["lang_pred"] == rows[i][2] for i in range(60)) and all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (60, 61, 62))
    spans = language_id.Labeller(m).spans("the house and the river the house and la maison et la rivière la maison")
    assert [s[2] for s in spans] == ["en", "fr"]
    assert language_id.identify(docs, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_paths_are_the_best_of_all(spark):
    """Viterbi against every labelling of short texts."""
    import itertools

    import numpy as np

    m = language_id.Model(["a", "b", "c"], {}, {}, [])
    own = np.random.default_rng(4)
    for switch in (0.5, 2.0, 6.0):
        lab = language_id.Labeller.__new__(language_id.Labeller)
        lab.m, lab.switch = m, switch
        sizes = own.integers(0, 7, 60)
        at = np.concatenate([[0], np.cumsum(sizes)])
        score = (own.integers(-8, 1, (at[-1], 3)) * own.choice([0.5, 1.0])).astype(np.float32)
        label = lab.paths(score, at)
        assert label.dtype == np.int32
        worth = lambda part, p: sum(part[i, k] for i, k in enumerate(p)) - switch * sum(x != y for x, y in zip(p, p[1:], strict=False))
        for a, b in zip(at, at[1:], strict=False):
            part = score[a:b].astype(float)
            best = max((worth(part, p) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert abs(worth(part, label[a:b].tolist()) - best) < 1e-6


def test_spans_ties_and_repeats(spark):
    rows = [(i, ("the house isn't near the river " if i % 2 else "la maison n'est pas la rivière ") * 20, "en" if i % 2 else "fr") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit(d)
    assert any(g == "=isnt" for g in m.table)
    mixed = "the house isn't near the river the house and la maison n'est pas la rivière la maison"
    t = spark.createDataFrame([(1, mixed, "x", 1), (1, mixed, "y", 2), (None, "the river house", "z", 3), (3, "123 !", None, 4), (4, "xq zw", None, 5)], "doc_id long, text string, lang string, n_spans int")
    out = language_id.identify(t, m).collect()
    assert [r["n_spans"] for r in out[:2]] == [2, 2] and out[0][2:] == out[1][2:]
    assert not out[2]["held_out"] and out[2]["lang_pred"] == "en" and (out[3]["lang_pred"], out[3]["score"]) == ("und", 0)
    spans = language_id.mixed_spans(t, m).where("doc_id = 1").collect()
    assert [r["lang"] for r in spans] == ["en", "fr"] * 2 and spans[0]["end_word"] == spans[1]["first_word"]
    # A word that tells nothing goes to the first language.
    even = language_id.Labeller(language_id.Model(["b1", "b2"], {}, {}, [(0.0, 0.0)] * 5))
    assert even.predict(language_id.pa.array(["zz zz"], language_id.pa.large_string()))[0] == ["b1"]


def test_quotation_is_told_from_abuse(spark):
    own = random.Random(6)
    plain = lambda n: " ".join(own.choice(WORDS) for _ in range(n))
    bare = lambda: f"{plain(12)} you worthless scumbag {plain(12)}"
    quoted = lambda: f'{plain(12)} he said the word "scumbag" again {plain(12)}'
    rows = [(i, [plain(25), bare(), plain(25), quoted()][i % 4], int(i % 4 == 1)) for i in range(600)]
    probes = [(900, bare(), 1), (901, quoted(), 0), (902, f"{plain(9)} you worthles scumbgag {plain(9)}", 1), (903, plain(30), 0), (None, bare(), 1), (904, None, 0), (904, bare(), 1)]
    d = spark.createDataFrame([(i, t, 5, "x") for i, t, _ in rows + probes], "doc_id long, text string, score int, y string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows] + [(2, 1), (None, 1)], "doc_id long, toxic int")
    m = toxicity.fit(d, lab)
    out = toxicity.score(d, m).collect()[len(rows) :]
    assert [r["predicted"] for r in out] == [y for _, _, y in probes] and out[1]["score"] < out[0]["score"] and not out[4]["held_out"]


def test_settings_are_chosen_inside_the_training_rows():
    import numpy as np

    own = np.random.default_rng(1)
    y = own.integers(0, 2, 400).astype(float)
    x = own.normal(0, 1, (400, len(toxicity.SETTINGS), 2)) * 0.01
    x[:, 2] += np.stack([y, y], 1)
    inner = np.arange(400) % 4 == 0
    assert toxicity.choose_setting(x, y, inner) == 2
    x[:, :] = x[:, :1]
    assert toxicity.choose_setting(x, y, inner) == 0 and toxicity.choose_setting(x, np.ones(400), inner) == 0


def test_toxicity(spark, docs, empty):
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + (" you worthless idiot" if i % 4 == 0 else ""), i % 4 == 0) for i in range(400)] + [(400, None, False), (401, "", False), (402, "an idoit and wortless words", False)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], int(r[2])) for r in rows[:402]], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    assert all(out[i]["predicted"] == int(t) for i, _, t in rows[:402]) and out[402]["predicted"] == 1
    assert toxicity.score(docs, toxicity.fit(empty, lab.limit(0))).where("score > 0.5").count() == 0
    m = toxicity.Matcher({"worthless": 7.0, "idiot": 6.0, "lowei*": 5.0})

    def distance(a, b):
        t = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    for _ in range(400):
        w = list(rng.choice(["worthless", "idiot"]))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice("abio")], [w[i], "x"]])
            w = w or ["a"]
        w = "".join(w)
        assert (m.match(w) is not None) == (distance(w, "worthless") <= 2 or distance(w, "idiot") <= 1), w
    assert m.match("loweixyz") == (5.0, 0)


def test_inflected_terms_are_matched_with_misspellings():
    words = Counter({"idiot": 120, "idiots": 80})
    stats = Counter()
    for w, n in words.items():
        for t in toxicity.forms(w):
            stats[t] += n
    lexicon = toxicity.choose_terms([(t, n, 0) for t, n in stats.items()], 1000, 3000)
    m = toxicity.Matcher(lexicon)
    assert any(t.endswith("*") for t in lexicon)
    assert all(m.match(w) is not None for w in ("idiot", "idiots", "idiotic", "idoit", "iidot", "idoits"))
    assert m.match("river") is None


def test_quality_classifier(docs, empty, spark):
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, quality_classifier.fit(docs, lab), F.col("source"), F.col("lang")).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.classify(empty, quality_classifier.fit(empty, lab.limit(0)), F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_to_their_host_and_the_corpus(spark):
    """Posteriors against the formula, by plain loops over the document scores."""
    import math

    own = random.Random(9)
    good = lambda: " ".join(own.choice(WORDS) + "." for _ in range(80))
    bad = lambda: " ".join("BUY $$ | NOW !!" for _ in range(20))
    rows = []
    for h in range(12):
        share = 0.9 if h % 2 else 0.2
        for k in range([1, 3, 40, 90][h % 4]):
            rows.append((len(rows), good() if own.random() < share else bad(), f"h{h}", f"p{k % 5}"))
    rows += [(None, None, None, None), rows[5]]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    lab = spark.createDataFrame([(i, int("BUY" not in rows[i][1])) for i in range(len(rows) - 2)], "doc_id long, quality int")
    out = quality_classifier.classify(d.withColumn("p", F.lit(1)).withColumn("site_id", F.lit(2)), quality_classifier.fit(d, lab), F.col("host"), F.col("path")).collect()
    assert len(out) == len(rows)
    at = {}
    for r, (i, _, h, p) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        at.setdefault((h or "", p or ""), []).append((r["doc_score"], r))
    hosts = {}
    for (h, _), v in at.items():
        hosts.setdefault(h, []).extend(s for s, _ in v)
    scores = [s for v in hosts.values() for s in v]
    mean = sum(scores) / len(scores)

    def strength(groups):
        many = [(v, c) for v, c in groups if len(v) > 1]
        m = [sum(v) / len(v) for v, _ in many]
        within = max(sum(sum(s * s for s in v) - len(v) * a * a for (v, _), a in zip(many, m, strict=True)) / sum(len(v) - 1 for v, _ in many), 1e-6)
        between = sum((a - c) ** 2 for (_, c), a in zip(many, m, strict=True)) / len(m) - within * sum(1 / len(v) for v, _ in many) / len(m)
        return min(max(within / max(between, 1e-9), 1.0), 1e6)

    k_h = strength([(v, mean) for v in hosts.values()])
    k_p = strength([([s for s, _ in v], sum(hosts[h]) / len(hosts[h])) for (h, _), v in at.items()])
    logit = lambda x: math.log(x / (1 - x))
    clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    for (h, _), v in at.items():
        for s, r in v:
            host = clip((sum(hosts[h]) - s + k_h * mean) / (len(hosts[h]) - 1 + k_h))
            path = clip((sum(x for x, _ in v) - s + k_p * host) / (len(v) - 1 + k_p))
            assert abs(r["host_posterior"] - host) < 1e-6 and abs(r["path_posterior"] - path) < 1e-6
            assert abs(r["score"] - 1 / (1 + math.exp(-(logit(s) + logit(path) - logit(clip(mean)))))) < 1e-6
            if len(hosts[h]) == 1:
                assert abs(host - mean) < 1e-9 and abs(path - mean) < 1e-9
    # Where documents are from can come from a table of its own.
    sites = spark.createDataFrame([(0, "other", "x")], "doc_id long, host string, path string")
    moved = quality_classifier.classify(d, quality_classifier.fit(d, lab), F.col("host"), F.col("path"), sites).where("doc_id = 0").first()
    assert abs(moved["host_posterior"] - mean) < 1e-6
    h, p = quality_classifier.site_of(F.lit("https://Www.A.example:80/en/25/x?q=1#t"), 2)
    assert tuple(spark.range(1).select(h, p).first()) == ("www.a.example", "en/25")


def test_passages(spark, empty):
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    base, rows = fresh(60), []
    for k in range(30):
        p = list(base)
        if k % 2:
            p[rng.randrange(60)] = f"edit{k}"
        rows.append((k, " ".join(fresh(rng.randrange(10, 90)) + p + fresh(rng.randrange(10, 90)))))
    rows += [(k, " ".join(fresh(60) + "a common line that is short".split() + fresh(60))) for k in range(30, 60)]
    rows += [(60, None), (61, ""), (None, " ".join(base)), (62, " ".join(fresh(30_000)))]
    out = passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == set(range(30))
    assert passage_dedup.repeated_passages(empty).count() == 0


def test_equal_texts_and_repeated_words(spark):
    fresh = lambda n: " ".join(f"y{rng.randrange(10**9)}" for _ in range(n))
    whole, run = fresh(80), " ".join(["ha"] * 70)
    rows = [(1, whole), (2, whole), (3, f"{fresh(20)} {whole} {fresh(20)}"), (4, f"{fresh(9)} {run} {fresh(30)}"), (5, f"{fresh(40)} {run}"), (6, fresh(20)), (7, fresh(100))]
    rows += [(8, rows[5][1])]
    out = passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 5}
    assert [(r["start_word"], r["end_word"], r["rep_doc_id"]) for r in out if r["doc_id"] == 2] == [(0, 80, 1)]
    assert any((r["doc_id"], r["rep_doc_id"], r["start_word"], r["end_word"]) == (3, 1, 20, 100) for r in out)
    assert any((r["doc_id"], r["rep_doc_id"]) == (5, 4) for r in out)


def test_passages_of_least_size_with_one_edit(spark):
    own = random.Random(11)
    fresh = lambda n: [f"x{own.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(300):
        p = fresh(50)
        rows += [(2 * k, fresh(100) + p + fresh(100)), (2 * k + 1, fresh(100) + [w if i != (20, 25, 30)[k % 3] else "edit" for i, w in enumerate(p)] + fresh(100))]
    out = passage_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")).collect()
    assert len({r["doc_id"] for r in out}) >= 2 * 297


def test_passages_with_partial_copies_first(spark):
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    p = fresh(60)
    rows = [(k, fresh(100) + p[k : k + 40] + fresh(100)) for k in range(20)] + [(k, fresh(100) + p + fresh(100)) for k in range(20, 24)]
    # Edited elsewhere: the smallest id is similar to the plain text only.
    q = fresh(60)
    rows += [(30 + k, fresh(100) + [f"e{k}" if i in at else w for i, w in enumerate(q)] + fresh(100)) for k, at in enumerate(((12,), (48,), ()))]
    out = passage_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {20, 21, 22, 23, 30, 31, 32}
    assert all(any(r["doc_id"] == k and r["rep_doc_id"] == 20 and r["end_word"] - r["start_word"] >= 60 for r in out) for k in (21, 22, 23))


def test_passages_in_a_crowd(spark, monkeypatch):
    """What is found does not depend on how many others share a phrase, nor on where groups are cut."""
    own = random.Random(8)
    fresh = lambda n: [f"x{own.randrange(10**9)}" for _ in range(n)]
    phrase = fresh(16)
    # The smallest id has nothing but the phrase, so that all others fail against it.
    few, crowd = [(0, fresh(60) + phrase + fresh(60))], [(k, fresh(60) + phrase + fresh(60)) for k in range(100, 250)]
    for k in range(30):
        p = fresh(17) + phrase + fresh(17)
        few += [(2 * k + 1, fresh(60) + p + fresh(60)), (2 * k + 2, fresh(60) + [w if i != (10, 40)[k % 2] else "edit" for i, w in enumerate(p)] + fresh(60))]
    frame = lambda rows: spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    found = lambda rows: {tuple(r) for r in passage_dedup.repeated_passages(frame(rows)).collect()}
    alone = found(few)
    assert len({r[0] for r in alone}) >= 58
    assert found(few + crowd) == alone
    monkeypatch.setattr(passage_dedup, "BLOCK", 20)
    assert found(few + crowd) == alone


def test_sets_of_passages_are_joined_by_few_links(spark):
    own = random.Random(9)
    fresh = lambda n: [f"x{own.randrange(10**9)}" for _ in range(n)]
    p = fresh(60)
    rows = [(0, fresh(50) + p[10:40] + fresh(50))] + [(k, fresh(50) + p + fresh(50)) for k in range(1, 50)]
    out = passage_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")).collect()
    pairs, reached = {(r["doc_id"], r["rep_doc_id"]) for r in out if r["doc_id"] != r["rep_doc_id"]}, {1}
    for _ in rows:
        reached |= {x for e in pairs if reached & set(e) for x in e}
    assert reached == set(range(1, 50)) and len(pairs) <= 3 * 49


def test_second_place_of_the_first_document(spark):
    own = random.Random(10)
    fresh = lambda n: [f"x{own.randrange(10**9)}" for _ in range(n)]
    p = fresh(60)
    rows = [(1, fresh(30) + p + fresh(300) + p + fresh(30)), (2, fresh(35) + p + fresh(35))]
    out = passage_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")).collect()
    assert {(r["start_word"], r["end_word"]) for r in out if r["doc_id"] == 1} == {(30, 90), (390, 450)}


def test_few_repeated_words_are_no_passage(spark):
    fresh = lambda n: " ".join(f"y{rng.randrange(10**9)}" for _ in range(n))
    rows = [(1, f"{fresh(60)} {'ha ' * 11}{fresh(60)}"), (2, f"{fresh(60)} {'ha ' * 60}{fresh(60)}")]
    assert passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Joins of lists of places to texts leave the texts where they are, whatever their size."""
    from kinweave.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, _ = passage_dedup.copies(spark.createDataFrame([(k, f"w{k} " * 60) for k in range(20)], "doc_id long, text string"))
        at = docs.select("doc_id", F.lit(3).alias("c"))
        plan = passage_dedup.beside(docs, at, 92)._jdf.queryExecution().executedPlan().toString()
        # The list's side is bucketed as the texts are here: nothing is shuffled at all.
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert docs.count() == 20
        common.discard(docs)
        assert not spark.catalog.tableExists(docs._kinweave_table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_words_are_not_compared_in_pairs(monkeypatch):
    """Runs of one word in a group of many: who has too few places of it is left out before any pair is looked at."""
    import numpy as np

    own, n, size = random.Random(12), 61, 46
    fresh = lambda k: [own.randrange(100, 2**30) for _ in range(k)]
    # The last three are runs of shingle 7; all others have it ten times, and something in common with a neighbour far from there.
    beside = [fresh(60) for _ in range(n)]
    h = [np.array(beside[k // 2] + fresh(32) + [7] * 10 + fresh(83) if k < 58 else fresh(92) + [7] * 93, np.int32) for k in range(n)]
    cols = [np.arange(n), np.full(n, 92), np.zeros(n, int), np.full(n, 184), np.ones(n, int), np.full(n, 92)]
    calls, plain = [], passage_dedup.similar_parts
    monkeypatch.setattr(passage_dedup, "similar_parts", lambda *a: calls.append(1) or plain(*a))
    links = list(passage_dedup.Group(cols, h, size, 0.8).links())
    assert {y for x in links for y in (x[0], x[3])} == {58, 59, 60}
    assert len(calls) <= 3
    # So by counts over all.
    monkeypatch.setattr(passage_dedup, "FEW", 0)
    assert list(passage_dedup.Group(cols, h, size, 0.8).links()) == links


def test_extents_of_edited_passages(spark):
    """Recall in words against what was planted, of longer passages with several edits at similarity 0.8 or more."""
    own = random.Random(21)
    fresh = lambda n: [f"x{own.randrange(10**9)}" for _ in range(n)]
    rows, size = [], {}
    for k in range(60):
        n = own.choice([60, 100, 200, 300])
        p = fresh(n)
        q = list(p)
        for i in own.sample(range(5, n - 5), {60: 1, 100: 2, 200: 4, 300: 6}[n]):
            q[i] = f"edit{i}"
        size[2 * k + 1] = n
        rows += [(2 * k, fresh(80) + p + fresh(80)), (2 * k + 1, fresh(80) + q + fresh(80))]
    d = spark.createDataFrame([(k, " ".join(t), 1, "s", 2) for k, t in rows], "doc_id long, text string, k int, sign string, fn int")
    covered = defaultdict(set)
    for r in passage_dedup.repeated_passages(d.unionByName(d.where("doc_id = 3"))).collect():
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    shares = [len(covered[k] & set(range(80, 80 + n))) / n for k, n in size.items()]
    assert sum(x > 0 for x in shares) >= 0.95 * len(shares) and sum(shares) / len(shares) >= 0.9
    assert sum(len(covered[k] - set(range(80, 80 + n))) for k, n in size.items()) == 0


def test_parts_of_a_passage_with_an_insertion():
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    p = fresh(300)
    for first, gap in ((50, 30), (150, 70)):
        q = p[: 2 * first]
        a, b = fresh(40) + q + fresh(40), fresh(40) + q[:first] + fresh(gap) + q[first:] + fresh(40)
        for x, y in ((a, b), (b, a)):
            parts = passage_dedup.similar_parts(*(passage_dedup.shingles([" ".join(t).encode()])[0] for t in (x, y)), 46, 0.8)
            found = {w for s, e, *_ in parts for w in x[s : e + 4]}
            assert set(q) <= found and all(j >= 0.8 for *_, j in parts)


def test_tree_windows_brute_force():
    import numpy as np

    h = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    n = np.array([120, 0, 5, 175])
    c, lo, hi = passage_dedup.compact_windows(h, n, np.uint64(7), 10)
    value, want, at = passage_dedup.mix64(h ^ np.uint64(7)), set(), 0
    for k in n:
        for i in range(at, at + k):
            a = b = i
            while a > at and value[a - 1] > value[i]:
                a -= 1
            while b < at + k - 1 and value[b + 1] > value[i]:
                b += 1
            if b - a + 1 >= 10:
                want.add((i, a, b))
        at += k
    assert set(zip(c.tolist(), lo.tolist(), hi.tolist(), strict=True)) == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(90)) + "." for _ in range(30)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate([*base, *base[:5], None, "", "short."])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert {r["doc_id"] for r in seen[1].collect()} == set(range(35))
    assert sorted(r["doc_id"] for r in seen[2].collect()) == list(range(30))
    assert set(r["doc_id"] for r in seen[5].collect()) <= set(range(30)) and seen[4].count() == seen[5].count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r["doc_id"] for r in seen[5].collect())
