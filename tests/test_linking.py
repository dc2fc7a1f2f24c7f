"""Operators against loops, and the derived fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.config import NICKNAMES, SCHEDULE_NICKNAMES, LinkConfig
from kinweave.functions import scalars as S
from kinweave.operators import blocking, calibration, matching, ordered, sampling, scoring
from kinweave.plans import schedule, verified
from kinweave.sources import files

rng = random.Random(4)


def test_greedy_equals_the_sequential_pass(spark):
    for _ in range(4):
        edges = sorted({(rng.randrange(12), rng.randrange(12), rng.choice([0.5, 0.7, 0.9])) for _ in range(60)})
        edges = list({(a, b): s for a, b, s in edges}.items())
        d = spark.createDataFrame([(a, b, s) for (a, b), s in edges], "l int, r int, s double")
        got = {(r["l"], r["r"]) for r in matching.greedy_one_to_one(d, "l", "r", [-F.col("s"), F.col("l"), F.col("r")]).collect()}
        used_l, used_r, want = set(), set(), set()
        for (a, b), _ in sorted(edges, key=lambda e: (-e[1], e[0])):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                want.add((a, b))
        assert got == want


def test_running_values(spark):
    rows = [(i, rng.choice([None, "x", "y"]), rng.randrange(3)) for i in rng.sample(range(1000), 300)]
    got = {r["k"]: r for r in ordered.running(spark.createDataFrame(rows, "k int, v string, n int"), ["k"], {"total": F.col("n")}, {"seen": F.col("v")}, "place").collect()}
    total, seen = 0, None
    for place, (k, v, n) in enumerate(sorted(rows), 1):
        total, seen = total + n, v or seen
        assert (got[k]["total"], got[k]["seen"], got[k]["place"]) == (total, seen, place)
    assert ordered.running(spark.createDataFrame([], "k int"), ["k"], place="p").count() == 0


def test_close_names_finds_all(spark):
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(250)})
    d = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["name_a"], r["name_b"]) for r in blocking.close_names(d, "w").collect()}
    assert got == {(a, b) for a in words for b in words if a < b and S.jaro_winkler(a, b) >= 0.85}
    assert blocking.close_names(d.limit(0), "w").count() == 0


def test_context_falls_back_to_the_first_row(spark):
    items = spark.createDataFrame([(i,) for i in range(40)], "i int")
    w = blocking.context_window(items, ["i"], items.where("i = 20"), ["i"]).collect()
    assert sorted(r["i"] for r in w) == list(range(8, 33)) and all(r["matched"] for r in w)
    w = blocking.context_window(items, ["i"], items.where("i = 99"), ["i"]).collect()
    assert sorted(r["i"] for r in w) == list(range(13)) and not any(r["matched"] for r in w)


NAMES = [
    ("John", "Jno", "exact", 1.0), ("William", "Willaim", "exact", 0.85), ("John", "John", "weak", 0.7), ("John", "John", "none", 0.4),
    ("John", "Peter", "exact", 0.3), ("J", "John", "exact", 0.55), ("J", "J", "exact", 0.35), ("J", "Peter", "exact", 0.3), ("", "John", "exact", 0.3), ("", "John", "none", 0.0),
    ("William", "Willaim", "weak", 0.7), ("William", "Willaim", "none", 0.4), ("J", "John", "weak", 0.0), ("John", "Peter", "weak", 0.0), ("", "John", "weak", 0.0), ("J", "J", "none", 0.0),
]
CODES = {"exact": ("SM0:XMT", "SM0:XMT"), "weak": ("AAA:XMT", "BBB:XMT"), "none": ("AAA:CCC", "BBB:DDD")}


def test_name_match(spark):
    rows = [(i, a, b, *CODES[kind]) for i, (a, b, kind, _) in enumerate(NAMES)]
    d = spark.createDataFrame(rows, "i int, a string, b string, ma string, mb string")
    side = lambda t: d.select("i", F.col(t).alias("first_name"), F.lit("").alias("norm_first_name"), F.lit("").alias("full_name"), F.lit(f"last{t}").alias("last_name"), F.col(f"m{t}").alias("metaphone_last_name"), F.lit("").alias("nysiis_last_name"))
    cols = lambda t: side(t).select("i", *[v.alias(k) for k, v in schedule.name_columns(side(t), t).items()])
    got = {r["i"]: r["name_score"] for r in schedule.name_scores(cols("a").join(cols("b"), "i"), "a", "b").collect()}
    assert [got[i] for i in range(len(NAMES))] == [x[3] for x in NAMES]


def test_surname_kinds_and_codes(spark):
    rows = [("SM0:XMT", "SM0:XXX", 1.0), ("A:B", "B:C", 0.8), ("A", "C:A", 0.8), ("A:X", "B:X", 0.6), ("A:B", "C:D", 0.0), ("", "A", None), (None, "A", None), ("12", "A", 0.0)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, w double")
    assert all(r["got"] == r["w"] for r in d.select("w", S.metaphone_agreement(F.col("a"), F.col("b")).alias("got")).collect())


def test_enumerator_bonus(spark):
    rows = [("6.4", "6.4", 0.5), ("6.1", "6.10", 0.5), ("6.11", "6.1", 0.4), ("6.30", "7.1", 0.4), ("6.4", "6.6", 0.3), ("6.4", "6.11", 0.2), ("6.4", "9.20", 0.0)]
    d = spark.createDataFrame(rows, "a string, b string, w double")
    assert all(r["w"] == r["g"] for r in d.select("w", S.enumerator_bonus(F.lit("Ann"), F.col("a"), F.lit("ann"), F.col("b")).alias("g")).collect())
    assert d.select(S.enumerator_bonus(F.lit("Ann"), F.col("a"), F.lit("Bob"), F.col("b")).alias("g")).where("g <> 0").count() == 0


def test_titles_and_punctuation(spark):
    def loop(name):
        changed = True
        while changed:
            changed = False
            for p in sorted(S.PREFIXES, key=len, reverse=True):
                if name.upper().startswith(p) and (len(name) == len(p) or name[len(p)] in ". "):
                    name, changed = name[len(p) :].lstrip(". "), True
                    break
        return name

    names = ["CAPT. Dr John Doe", "Drake", "DR", "Ltc Lt Ann", "1SGT.Bob", "Ens. Cpt Poe", "col", "MRS.  MR. X", "Missy", "Lieut Roe", "MS Roe", "dr.", "Colonel Roe", ""]
    names += [" ".join(rng.choice([*S.PREFIXES, "Ann", "dr.", "LT.", "Moe"]) for _ in range(4)) for _ in range(60)]
    d = spark.createDataFrame([(n, loop(n)) for n in names], "n string, w string")
    assert [r["w"] for r in d.collect()] == [r["g"] for r in d.select(S.strip_prefixes(F.col("n")).alias("g")).collect()]
    assert spark.range(1).select(S.strip_punctuation(F.lit("Zoë_“Zed”  O'Neil,  (Jr.)"))).first()[0] == "ZoëZ" [:3] + "“Zed” O'Neil Jr"


def test_nickname_tables():
    assert NICKNAMES["frank_f"] == "frances" and len(NICKNAMES) == 62 and NICKNAMES["sam"] == "samuel"
    assert SCHEDULE_NICKNAMES["JNO"] == "JOHN" and SCHEDULE_NICKNAMES["FRANK"] == "FRANCIS"


TUPLES = [
    (r"(1,'augusta',1860,'Mary',NULL,'Carter'),", ["1", "augusta", "1860", "Mary", "", "Carter"]),
    (r"(2, 'O\'Brien' , 'say \"hi\"', 'a\\b', 'x\ny');", ["2", "O'Brien", 'say "hi"', "a\\b", "x\ny"]),
    (r"(3,'it''s','','a, (b)',null , 4.5 )", ["3", "it's", "", "a, (b)", "", "4.5"]),
    (r"('\\','\\\'','t\tr\r0\0z\q')", ["\\", "\\'", "t\tr\r0\0zq"]),
    ("(5,)", ["5"]), ("()", []), ("(a(b)c,d)", ["a(b)c", "d"]), ("('open", ["open"]),
]


def test_sql_tuples(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TUPLES)], "i int, t string")
    got = {r["i"]: r["v"] for r in d.select("i", files.parse_tuples(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(TUPLES))] == [w for _, w in TUPLES]


def test_census_extract(spark):
    text = ["INSERT INTO `population_census` (`id`, `county`, `year`, `name`) VALUES", "\t(1,'Augusta',1860,'Mary'),", "(2,'augusta',1870,'Ann'),", "(3,'rock',1860,'Ben');", "UNLOCK TABLES;", "(4,'augusta',1860,'lost')"]
    lines = spark.createDataFrame(list(enumerate(text)), "n long, value string")
    d = files.census_extract(lines, "augusta", 1860)
    assert d.columns == ["n", "id", "county", "year", "name"] and [tuple(r)[1:] for r in d.collect()] == [("1", "Augusta", "1860", "Mary")]
    assert files.census_extract(lines, "none", 1860).count() == 0


def test_schedule_builder(spark):
    rows = [("1", "Owner", "John Taylor"), ("2", "", ""), ("2", "", ""), ("3", "Owner", "Ann Poe"), ("4", "", ""), ("5", "Owner", "John Taylor"), ("6", "", "")]
    h = files.schedule_households(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, line string, status string, full_name string"), "ALB", 1850)
    m = files.schedule_mentions(h, "ALB", 1850).orderBy("n").collect()
    assert [(r["mention_id"], r["household_id"], r["head"], r["legal_status"]) for r in m] == [
        ("ALB-SS-1850-1", "HS1850-1", "Y", ""), ("ALB-SS-1850-2", "HS1850-1", "", "E"), ("ALB-SS-1850-2.2", "HS1850-1", "", "E"),
        ("ALB-SS-1850-3", "HS1850-2", "Y", ""), ("ALB-SS-1850-4", "HS1850-2", "", "E"), ("ALB-SS-1850-6", "HS1850-3", "", "E"),
    ]
    assert list(m[0].asDict())[1:] == list(files.SCHEDULE_MENTION)
    a = files.schedule_assertions(h, 1850).orderBy("n").collect()
    assert [(r["subject"], r["object"]) for r in a] == [("ALB-SS-1850-2", "ALB-SS-1850-1"), ("ALB-SS-1850-2.2", "ALB-SS-1850-1"), ("ALB-SS-1850-4", "ALB-SS-1850-3"), ("ALB-SS-1850-6", "ALB-SS-1850-1")]
    assert list(a[0].asDict())[1:] == list(files.SCHEDULE_ASSERTION)


def test_listing_and_grid(spark, tmp_path):
    html = """<div class="memorial-item x"><h2 class="name-grave"><div>V</div>Capt. <i>John</i> Doe_</h2><b class="birthDeathDates">5 May 1801 – 1879</b>
        <div class="memorial-item---cemet"><p class="addr-cemet">Oak Hill,<br> Va.</p></div></div><div class="memorial-item"><p class="addr-cemet">no</p></div><div class="memorial-item"><h2 class="name-grave">Dr</h2></div>"""
    got = files.listing_rows(spark.createDataFrame([(1, html), (2, None), (3, html)], "page_id int, html string")).orderBy("line").collect()
    assert [tuple(r) for r in got] == [(1, "John Doe", "1801", "1879", "Oak Hill Va"), (2, "Dr", "", "", ""), (3, "John Doe", "1801", "1879", "Oak Hill Va"), (4, "Dr", "", "", "")]
    grid = files.grid_rows(spark.createDataFrame([(1, 1, ["Ann, Poe", " x "]), (1, 2, ["", " "]), (2, 1, None), (4, 1, ["late"])], "page int, n int, cells array<string>")).collect()
    assert len(grid) == 1 and (grid[0]["line"], grid[0]["full_name"], grid[0]["maiden_name"], grid[0]["notes"]) == (1, "Ann Poe", "x", "")
    names = spark.createDataFrame([(1, "COL. A_b", "1800", None, "x"), (2, "", " ", "", None), (3, "Mr", "", "", "y!")], "n int, full_name string, birth_year string, death_year string, location string")
    files.write_csv(files.clean_rows(names, ["n"]), f"{tmp_path}/out", ["line"])
    back = files.first_csv(spark, [f"{tmp_path}/none", f"{tmp_path}/out"]).orderBy("line").collect()
    assert [tuple(r) for r in back] == [("1", "Ab", "1800", None, "x"), ("2", None, None, None, "y")]
    with pytest.raises(FileNotFoundError):
        files.first_csv(spark, [f"{tmp_path}/none"])


def test_all_fields(spark):
    d = spark.createDataFrame([("a", '{"x": "1", "name": "other", "hide": "2"}'), ("b", "no json"), (None, None)], "name string, original_data string")
    got = [r["fields"] for r in files.all_fields(d, ("original_data", "hide")).collect()]
    assert got == [{"name": "a", "x": "1"}, {"name": "b"}, {}]


def test_allocation():
    sizes = {"A": (900, 0.995), "B": (50, 0.97), "C": (20, 0.92), "E": (400, 0.6), "H": (3000, 0.02)}
    out = sampling.allocation(sizes)
    assert sum(out.values()) == 500 and all(min(n, 35) <= out[k] <= n for k, (n, _) in sizes.items())
    assert sampling.allocation({"A": (10, 0.99)}) == {"A": 10}


def test_calibration(spark):
    m = calibration.fit_names()
    p = [r[0] for r in spark.createDataFrame([(x / 10,) for x in range(20)], "s double").select(m.probability(F.col("s"))).collect()]
    assert p == sorted(p) and p[0] < 0.1 and p[18] > 0.9 and 0.7 < m.mean < 1
    rows = [(rng.random(), rng.random()) for _ in range(400)]
    d = spark.createDataFrame([(a, b, int(a + rng.gauss(0, 0.2) > 0.5)) for a, b in rows], "a double, b double, y int")
    w = calibration.fit_levers(d, ["a", "b"], "y")
    assert w[0] > 3 and abs(w[1]) < 2


def person(i, first, last, born, **more):
    base = {"mention_id": f"AUG-CN-1860-{i}", "person_id": f"AUG-VP-{i}", "full_name": f"{first} {last}", "first_name": first, "last_name": last, "nysiis_last_name": last.upper()[:3], "birth_year": born, "death_year": None, "gender": "M", "norm_race": "W", "household_id": None}
    return base | more


COLUMNS = "mention_id person_id full_name first_name last_name nysiis_last_name birth_year death_year gender norm_race household_id source n"


def test_match_verified(spark):
    people = [person(1, "John", "Carter", "1820-1822"), person(2, "John", "Carter", "1830", death_year="1850"), person(3, "Ann", "Poe", "1840", gender="F"), person(4, "Ned", "Hall", "1810"), person(5, "J", "Carter", "1821"), person(6, "Sam", "Moe", "1800")]
    census = [person(11, "John", "Carter", "1821"), person(12, "Ann", "Poe", "1853", gender="F"), person(13, "Edward", "Hall", "1811"), person(14, "Sam", "Moe", "1800", norm_race="M"), person(15, "Anne", "Poe", "1841", gender="F")]
    make = lambda rows, src: spark.createDataFrame([tuple({**r, "source": src, "n": i}.get(c) for c in COLUMNS.split()) for i, r in enumerate(rows)], ", ".join(f"{c} {'int' if c == 'n' else 'string'}" for c in COLUMNS.split()))
    found = verified.match_verified(make(people, "AUG-VP"), make(census, "aug-cn-1860"), "AUG", 1860, ["n"])
    got = {r["person"]["person_id"][-1]: r for r in found.collect()}
    assert got["1"]["status"] == "MATCH" and got["1"]["candidate"]["mention_id"].endswith("-11") and got["1"]["why"]["levers"]["surnameKind"] == "EXACT_FULLNAME"
    assert got["2"]["status"] == "UN-MATCHED" and got["2"]["why"]["note"] == "No candidate cleared blocking"
    assert got["3"]["candidate"]["mention_id"].endswith("-15") and got["4"]["candidate"]["mention_id"].endswith("-13") and got["6"]["candidate"] is None
    assert got["5"]["status"] == "UN-MATCHED" and got["5"]["why"]["note"].startswith("Lost") and got["5"]["why"]["runnerUps"][0]["mention_id"].endswith("-11")
    assert {r["status"]: r["n"] for r in verified.status_counts(found).collect()} == {"MATCH": 3, "UN-MATCHED": 3}
    assert verified.search(found, " edward ").count() == 1 and verified.search(found, "", "MATCH").count() == 3
    row = verified.review_rows(found).where("mention_id like '%-13'").first()
    assert row["full_name"] == "Edward Hall : Ned Hall" and row["norm_race"] == "W : W" and row["birth_year"] == "1811 : 1810"
    assert verified.review_sample(found).count() == 6
    seeds = verified.seed_persons(make(census, "AUG-CN-1860"), "AUG", ["n"]).orderBy("row_no").collect()
    assert [r["person_id"] for r in seeds[:2]] == ["AUG-VP-1000", "AUG-VP-1001"] and seeds[0]["mentions"] == '["AUG-CN-1860-11"]'


def test_lock_pass(spark):
    edges = [(1, "a", 0.9), (1, "b", 0.7), (2, "a", 0.95), (2, "c", 0.94), (3, "a", 0.85), (4, "d", 0.79), (5, "e", 0.9)]
    d = spark.createDataFrame(edges, "l int, r string, s double")
    got = {(x["l"], x["r"]) for x in matching.lock_pass(d, "l", "r", "s", [F.desc("s"), F.col("r")], [F.desc("s"), F.col("l")], 0.8).collect()}
    assert got == {(1, "a"), (5, "e")}


def test_schedule_matching(spark):
    cols = "mention_id full_name first_name last_name nysiis_last_name metaphone_last_name birth_year race norm_race head household_id district enumerator enumerator_date original_data source"
    base = {"nysiis_last_name": "TAL", "last_name": "Taylor", "race": "W", "enumerator": "Ann", "enumerator_date": "6.4"}
    rows = [
        {"mention_id": "s1", "full_name": "John Taylor", "first_name": "John", "head": "Y", "household_id": "h1", "source": "ALB-SS-1850", "original_data": '{"district": "East", "enumerator_date": "6.5"}'},
        {"mention_id": "s2", "first_name": "", "head": "", "household_id": "h1", "source": "ALB-SS-1850"},
        {"mention_id": "c1", "full_name": "Jno Taylor", "first_name": "Jno", "head": "t", "birth_year": "1800", "district": "EAST", "source": "ALB-CN-1850"},
        {"mention_id": "c2", "full_name": "Mary Taylor", "first_name": "Mary", "birth_year": "1810", "source": "ALB-CN-1850"},
        {"mention_id": "c3", "full_name": "Ann Taylor", "first_name": "Ann", "birth_year": "1845", "source": "ALB-CN-1850"},
    ]
    d = spark.createDataFrame([tuple((base | r).get(c) for c in cols.split()) for r in rows], ", ".join(f"{c} string" for c in cols.split()))
    heads = schedule.enslavers(d, "ALB", 1850)
    assert heads.first()["household_count"] == 1 and heads.first()["candidate_id"] == "ALB-VP-SS-1850-h1"
    found = schedule.match_schedule(heads, schedule.census_candidates(d, "ALB", 1850))
    r = found.first()
    assert (r["mention1"]["mention_id"], r["mention1"]["confidence"], r["birth_year"], r["matched_name"]) == ("c1", 2.0, "1800", "Jno Taylor")
    assert r["mention2"]["mention_id"] == "c2" and r["mention2"]["confidence"] == 0.7 and r["mention3"] is None
    assert tuple(schedule.totals(found).first()) == (1, 1, 100.0, 2)
    assert schedule.export_rows(found).first()["mention3"] == ""


def test_bridges_join_common_names(spark):
    config = LinkConfig(common_count=2)
    cols = "id_{0} string, last_{0} string, nysiis_{0} string, soundex_{0} string, canon_first_{0} string, birth_year_{0} int, gender_{0} string, family_id_{0} string"
    a = spark.createDataFrame([("a1", "gains", "G", "G1", "john", 1850, "M", None), ("a2", "smith", "S", "S1", "john", 1850, "M", None)], cols.format("a"))
    b = spark.createDataFrame([("b1", "rowe", "R", "R1", "john", 1850, "M", None)], cols.format("b"))
    bridges = spark.createDataFrame([("gains", "rowe")], "x string, y string")
    assert [tuple(r) for r in blocking.pass_given(a, b, config, bridges).collect()] == [("a1", "b1")]
    assert blocking.pass_given(a, b, config).count() == 0
    p = a.crossJoin(b).withColumn("similar", F.lit(False))
    assert {r["id_a"]: r["k"] for r in scoring.with_bridges(p, bridges).select("id_a", scoring.surname_kind().alias("k")).collect()} == {"a1": "bridge", "a2": "none"}


def test_entry_slice(spark, tmp_path):
    from kinweave.plans import queries

    rows = [(k, k % 7, "1-URGENT") for k in range(1, 40)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    ids = [r["id_a"] for r in queries.minimum_slice(spark, str(tmp_path)).collect()]
    assert ids and len(ids) == len(set(ids))


def _people(spark, n, seed, tag):
    r = random.Random(seed)
    pick = lambda *x: r.choice([None, *x])
    rows = [(f"{tag}{i}", i, pick("a", "b", "c"), pick("A", "B"), pick("S", "T"), pick(*"uvwxyz"), pick(1820, 1830, 1841, 1850), pick("M", "F"), pick("f1", "f2", "f3", "f4", "f5")) for i in range(n)]
    names = ("id", "seq", "last", "nysiis", "soundex", "canon_first", "birth_year", "gender", "family_id")
    return [dict(zip(names, x, strict=True)) for x in rows], spark.createDataFrame(rows, ", ".join(f"{k}_{tag} {'int' if k in ('seq', 'birth_year') else 'string'}" for k in names))


def _fits(x, y, gap):
    return (x["gender"] is None or y["gender"] is None or x["gender"] == y["gender"]) and (x["birth_year"] is None or y["birth_year"] is None or abs(x["birth_year"] - y["birth_year"]) <= gap)


def _passes(xs, ys, config, bridged=frozenset()):
    """Pairs of each pass, by loops."""
    eq = lambda x, y, k: x[k] is not None and x[k] == y[k]
    key = lambda x, y: (x["id"], y["id"])
    sur = lambda x, y: eq(x, y, "nysiis") or eq(x, y, "soundex")
    n = {x["canon_first"]: sum(y["canon_first"] == x["canon_first"] for y in xs) for x in xs}
    full = lambda x, y: x["last"] is not None and y["last"] is not None and (x["last"] == y["last"] or sur(x, y) or tuple(sorted((x["last"], y["last"]))) in bridged)
    one = {key(x, y) for x in xs for y in ys if sur(x, y) and _fits(x, y, 12)}
    two = {key(x, y) for x in xs for y in ys if eq(x, y, "canon_first") and _fits(x, y, 5) and (n[x["canon_first"]] < config.common_count or full(x, y))}
    fam = lambda x, y: (x["family_id"], y["family_id"])
    seeds = {}
    for x in xs:
        for y in ys:
            if key(x, y) in one | two and None not in fam(x, y):
                seeds.setdefault(fam(x, y), set()).add(key(x, y))
    three = {key(x, y) for x in xs for y in ys if seeds.get(fam(x, y), set()) - {key(x, y)} and _fits(x, y, 10)}
    return one, two, three


def test_surname_pairs_are_not_shuffled(spark):
    (xs, a), (ys, b) = _people(spark, 60, 1, "a"), _people(spark, 60, 2, "b")
    d = blocking.pass_surname(a, b, LinkConfig())
    # Only records are dealt out: no aggregate stands over the pairs.
    assert "HashAggregate" not in d._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in d.collect()]
    assert sorted(rows) == sorted(_passes(xs, ys, LinkConfig())[0])
    twice = a.unionByName(a.withColumn("nysiis_a", F.lit("B")))
    assert len(rows) < (n := blocking.pass_surname(twice, b, LinkConfig()).count()) == blocking.pass_surname(twice, b, LinkConfig()).distinct().count() and n


def test_given_pairs_are_not_shuffled(spark):
    (xs, a), (ys, b) = _people(spark, 60, 3, "a"), _people(spark, 60, 4, "b")
    config = LinkConfig(common_count=9)
    bridges = spark.createDataFrame([("a", "c")], "x string, y string")
    d = blocking.pass_given(a, b, config, bridges)
    assert d._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert sorted(tuple(r) for r in d.collect()) == sorted(_passes(xs, ys, config, {("a", "c")})[1])


def test_index_pairs_are_met_once(spark):
    r = random.Random(5)
    side = lambda n, t: spark.createDataFrame([(i, *[r.choice([None, "p", "q", "s", "u"]) for _ in range(4)], r.randrange(3)) for i in range(n)], f"no_{t} int, n_{t} string, f_{t} string, m1_{t} string, m2_{t} string, g_{t} int")
    x, y = side(40, "x"), side(40, "y")
    keys = {"N:": [("n_x", "n_y")], "F:": [("f_x", "f_y")], "M:": [("m1_x", "m1_y"), ("m2_x", "m2_y")]}
    d = blocking.index_joins(x, y, keys, F.col("g_x") == F.col("g_y"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    want = []
    for a in x.collect():
        for b in y.collect():
            left = [("N", a["n_x"]), ("F", a["f_x"]), ("M", a["m1_x"]), ("M", a["m2_x"])]
            right = {("N", b["n_y"]), ("F", b["f_y"]), ("M", b["m1_y"]), ("M", b["m2_y"])}
            via = next((i for i, k in enumerate(left) if k[1] is not None and k in right), None)
            if via is not None and a["g_x"] == b["g_y"]:
                want.append((a["no_x"], b["no_y"], via))
    assert sorted(tuple(z) for z in d.select("no_x", "no_y", "via").collect()) == sorted(want)


def test_passes_of_records(spark):
    (xs, a), (ys, b) = _people(spark, 70, 6, "a"), _people(spark, 70, 7, "b")
    config = LinkConfig(common_count=9)
    for bridges in (None, spark.createDataFrame([("a", "c")], "x string, y string")):
        d = blocking.block(a, b, config, bridges)
        got = [(r["id_a"], r["id_b"], tuple(r["passes"])) for r in d.collect()]
        passes = _passes(xs, ys, config, set() if bridges is None else {("a", "c")})
        want = {k: tuple(i + 1 for i, p in enumerate(passes) if k in p) for k in set().union(*passes)}
        assert sorted(got) == sorted((*k, v) for k, v in want.items())
        assert d._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_knockouts_of_marked_records(spark):
    one = lambda t, ids: spark.createDataFrame([(i, 1850, "M", "B", "S") for i in ids], f"id_{t} string, birth_year_{t} int, gender_{t} string, nysiis_{t} string, soundex_{t} string")
    a, b = one("a", ["a1", "a2", "a3"]), one("b", ["b1", "b2"])
    not_same = spark.createDataFrame([("b1", "a1"), ("a2", "b2"), ("a2", "b2")], "subject_id string, object_id string")
    a = blocking.marked(a, not_same, a.where("id_a in ('a2', 'a3')").select("id_a"))
    d = blocking.knock_out(a.crossJoin(b), LinkConfig())
    # The rules are told from the records: no join has the pairs on a shuffled side.
    assert d._jdf.queryExecution().optimizedPlan().toString().index("Join Cross") < d._jdf.queryExecution().optimizedPlan().toString().index("LeftOuter")
    got = {(r["id_a"], r["id_b"]): r["ko"] for r in d.collect()}
    assert got == {("a1", "b1"): "isNotSameAs", ("a1", "b2"): None, ("a2", "b1"): "deathBefore1880", ("a2", "b2"): "isNotSameAs", ("a3", "b1"): "deathBefore1880", ("a3", "b2"): "deathBefore1880"}
