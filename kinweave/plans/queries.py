"""The linker's operators as queries over the star-schema tables, and the same in SQL.

No table holds person mentions, so a deterministic stand-in is made from orders by integer arithmetic: every
order is a person of family o_custkey, listed in 1870 and again, with changes, in 1880.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.config import LinkConfig
from kinweave.functions import scalars as S
from kinweave.operators import blocking, family, matching, sampling, scoring
from kinweave.operators import calibration
from kinweave.plans import decennial, schedule, verified
from kinweave.sources import files

SYL = "ba,co,di,fu,ga,he,ji,ko,la,mo,ni,pa,ro,su,ta,vi,wa,yo,ze,lu"
FIRST = "john,mary,sam,sarah,william,henry,ned,jane,peter,betsy,thomas,lucy,robert,anna,willie,kate"

#: One text for both engines; {orders} is the table.
MENTIONS = f"""
    SELECT concat('SYN-CN-', y, '-', k) AS mention_id, concat('SYN-CN-', y) AS source, y AS census_year, CAST(c AS VARCHAR(20)) AS family_id, k AS seq,
           CASE WHEN y = 1880 AND k % 7 = 0 THEN substr(f, 1, 1) ELSE f END AS first_name,
           CASE WHEN y = 1880 AND c % 13 = 0 THEN concat('x', l) ELSE l END AS last_name,
           upper(CASE WHEN y = 1880 AND c % 13 = 0 THEN concat('x', l) ELSE l END) AS nysiis, upper(substr(l, 1, 5)) AS soundex,
           CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(1800 + (k * 13 + c * 5) % 65 + CASE WHEN y = 1880 THEN k % 5 - 2 ELSE 0 END AS INT) END AS birth_year,
           CASE WHEN y = 1880 AND k % 29 = 0 THEN NULL WHEN i % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
           CASE WHEN y = 1880 AND k % 31 = 0 THEN 'W' WHEN c % 3 = 0 THEN 'B' WHEN c % 3 = 1 THEN 'M' ELSE 'W' END AS race, occ AS occupation, k % 4 = 0 AS head
    FROM (SELECT k, c, i, occ, y, split_part('{FIRST}', ',', CAST(i + 1 AS INT)) AS f,
                 concat(split_part('{SYL}', ',', CAST(c % 20 + 1 AS INT)), split_part('{SYL}', ',', CAST(floor(c / 20) AS INT) % 20 + 1), split_part('{SYL}', ',', CAST(floor(c / 400) AS INT) % 20 + 1)) AS l
          FROM (SELECT o_orderkey AS k, o_custkey AS c, (o_orderkey * 7 + o_custkey) % 16 AS i, lower(o_orderpriority) AS occ FROM {{orders}}) o CROSS JOIN (SELECT 1870 AS y UNION ALL SELECT 1880 AS y) t)
"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MENTIONS, orders=_t(spark, sf_dir, "orders"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working records of the stand-in."""
    m, canon = mentions(spark, sf_dir), LinkConfig().nicknames
    return m.select(F.col("mention_id").alias("id"), "seq", F.col("first_name").alias("first"), F.col("last_name").alias("last"), F.col("first_name").alias("norm_first"), S.lookup(F.col("first_name"), canon).alias("canon_first"), F.substring("first_name", 1, 1).alias("initial"), "nysiis", "soundex", "birth_year", "gender", "race", "occupation", "head", "family_id", "census_year")


def _sides(spark, sf_dir):
    return blocking.sides(records(spark, sf_dir), LinkConfig())


SQL = f"""WITH m AS ({MENTIONS.format(orders='orders')}), r AS (SELECT *, CASE first_name WHEN 'sam' THEN 'samuel' WHEN 'ned' THEN 'edward' WHEN 'betsy' THEN 'elizabeth' WHEN 'willie' THEN 'william' WHEN 'kate' THEN 'catherine' ELSE first_name END AS canon FROM m),
    a AS (SELECT * FROM r WHERE census_year = 1870), b AS (SELECT * FROM r WHERE census_year = 1880)"""
FITS = "(a.gender = b.gender OR a.gender IS NULL OR b.gender IS NULL) AND (abs(a.birth_year - b.birth_year) <= {} OR a.birth_year IS NULL OR b.birth_year IS NULL)"
P1 = f"p1 AS (SELECT a.mention_id AS id_a, b.mention_id AS id_b FROM a JOIN b ON a.nysiis = b.nysiis WHERE {FITS.format(12)} UNION SELECT a.mention_id, b.mention_id FROM a JOIN b ON a.soundex = b.soundex WHERE {FITS.format(12)})"
P2 = f"g AS (SELECT canon, count(*) AS n FROM a GROUP BY canon), p2 AS (SELECT a.mention_id AS id_a, b.mention_id AS id_b FROM a JOIN g USING (canon) JOIN b ON a.canon = b.canon AND (n < 30 OR a.last_name = b.last_name OR a.nysiis = b.nysiis OR a.soundex = b.soundex) WHERE {FITS.format(5)})"
P3 = f"""s AS (SELECT id_a, id_b FROM p1 UNION SELECT id_a, id_b FROM p2), f AS (SELECT a.family_id AS fa, b.family_id AS fb, count(*) AS n, min(id_a) AS ia, min(id_b) AS ib FROM s JOIN a ON a.mention_id = id_a JOIN b ON b.mention_id = id_b GROUP BY ALL),
    p3 AS (SELECT a.mention_id AS id_a, b.mention_id AS id_b FROM f JOIN a ON a.family_id = fa JOIN b ON b.family_id = fb WHERE {FITS.format(10)} AND NOT (n = 1 AND ia = a.mention_id AND ib = b.mention_id))"""
LEVERS = """freq_l AS (SELECT last_name, count(*) AS nl FROM a GROUP BY 1), freq_g AS (SELECT canon, count(*) AS ng FROM a GROUP BY 1),
    x AS (SELECT a.mention_id AS id_a, b.mention_id AS id_b, CASE WHEN a.last_name = b.last_name THEN 'exact' WHEN a.nysiis = b.nysiis OR a.soundex = b.soundex THEN 'phonetic' ELSE 'none' END AS kind,
             CASE WHEN nl <= 3 THEN 1.5 WHEN nl >= 30 THEN 0.5 ELSE 1.0 END AS ms, CASE WHEN ng <= 3 THEN 1.5 WHEN ng >= 30 THEN 0.5 ELSE 1.0 END AS mg,
             a.first_name = b.first_name AS ex, a.canon = b.canon AS nk, substr(a.first_name, 1, 1) = substr(b.first_name, 1, 1) AS ini, coalesce(a.gender = 'M' AND b.gender = 'M', false) AS males,
             abs(a.birth_year - b.birth_year) AS gap, CASE WHEN a.race = b.race OR (a.race IN ('B', 'M') AND b.race IN ('B', 'M')) THEN 0.5 WHEN (a.race IN ('B', 'M') AND b.race = 'W') OR (a.race = 'W' AND b.race IN ('B', 'M')) THEN -1.5 ELSE 0.0 END AS race_value,
             CASE WHEN a.occupation = b.occupation AND coalesce(1870 - a.birth_year >= 16 AND 1880 - b.birth_year >= 16, false) THEN 0.4 ELSE 0.0 END AS occ_value
          FROM p1 JOIN a ON a.mention_id = id_a JOIN b ON b.mention_id = id_b JOIN freq_l ON freq_l.last_name = a.last_name JOIN freq_g ON freq_g.canon = a.canon),
    z AS (SELECT *, CASE WHEN gap IS NULL THEN 0.0 WHEN gap = 0 THEN 2.0 WHEN gap = 1 THEN 1.6 WHEN gap = 2 THEN 1.2 WHEN gap = 3 THEN 0.7 WHEN gap <= 5 THEN 0.3 ELSE -1.0 END AS b_value,
             CASE WHEN kind <> 'none' THEN CASE WHEN ex THEN 'exactFirstSurname' WHEN nk THEN 'nicknameSurname' WHEN ini THEN 'initialSurname' ELSE 'surnameOnly' END WHEN ex OR nk THEN 'givenOnly' WHEN males THEN 'maleSurnameMismatch' ELSE 'none' END AS rung FROM x),
    y AS (SELECT *, CAST(CASE rung WHEN 'exactFirstSurname' THEN 4.0 * (ms + mg) / 2 WHEN 'nicknameSurname' THEN 3.0 * (ms + mg) / 2 WHEN 'initialSurname' THEN 2.5 * ms WHEN 'givenOnly' THEN CASE WHEN b_value >= 1.2 THEN 1.5 * mg ELSE 0.0 END + CASE WHEN males AND kind = 'none' THEN -3.0 ELSE 0.0 END
             WHEN 'maleSurnameMismatch' THEN -3.0 ELSE 0.0 END AS DOUBLE) AS a_part FROM z)"""

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return put


@query(f"{SQL} SELECT mention_id, seq, lower(first_name) AS first, nullif(regexp_replace(lower(trim(last_name)), '[^a-z]', '', 'g'), '') AS last, canon, substr(first_name, 1, 1) AS initial FROM r")
def q01_normalize_names(spark, sf_dir):
    m = mentions(spark, sf_dir)
    first = S.clean_name(F.col("first_name"))
    return m.select("mention_id", S.parse_seq(F.col("mention_id")).alias("seq"), first.alias("first"), S.clean_name(F.col("last_name")).alias("last"), S.lookup(first, LinkConfig().nicknames).alias("canon"), F.substring(first, 1, 1).alias("initial"))


@query("""WITH e AS (SELECT event_id, props, CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' t ' WHEN 2 THEN '1850abc' WHEN 3 THEN '1850-1862' WHEN 4 THEN '' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)
    SELECT event_id, TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?\\d+)', 1), '') AS INT) AS n, lower(trim(v)) IN ('true', 't', '1', 'yes', 'y') AS flag,
           list_min(list_transform(regexp_extract_all(v, '\\d{3,4}'), lambda x: CAST(x AS INT))) AS lo, list_max(list_transform(regexp_extract_all(v, '\\d{3,4}'), lambda x: CAST(x AS INT))) AS hi FROM e""")
def q02_coerce_int_bool_years(spark, sf_dir):
    v = F.expr("CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' t ' WHEN 2 THEN '1850abc' WHEN 3 THEN '1850-1862' WHEN 4 THEN '' ELSE CAST(event_id AS STRING) END")
    d = _t(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return d.select("event_id", S.to_int(F.col("v")).alias("n"), S.is_true(F.col("v")).alias("flag"), S.year_range(F.col("v"))["lo"].alias("lo"), S.year_range(F.col("v"))["hi"].alias("hi"))


@query(f"{SQL} SELECT canon AS name, count(*) AS n, CAST(CASE WHEN count(*) <= 3 THEN 1.5 WHEN count(*) >= 30 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS mult FROM a GROUP BY 1 UNION ALL SELECT last_name, count(*), CAST(CASE WHEN count(*) <= 3 THEN 1.5 WHEN count(*) >= 30 THEN 0.5 ELSE 1.0 END AS DOUBLE) FROM a GROUP BY 1")
def q03_name_frequency_rarity(spark, sf_dir):
    a = records(spark, sf_dir).where("census_year = 1870")
    one = lambda c: a.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return one("canon_first").unionByName(one("last")).withColumn("mult", scoring.rarity(F.col("n"), LinkConfig()))


@query(f"{SQL} SELECT CAST(census_year AS INT) AS census_year, family_id, row_number() OVER (PARTITION BY census_year ORDER BY min(seq), family_id) - 1 AS place FROM r GROUP BY census_year, family_id")
def q04_family_order(spark, sf_dir):
    return family.family_order(records(spark, sf_dir))


@query(f"{SQL}, {P1} SELECT * FROM p1")
def q05_block_phonetic(spark, sf_dir):
    return blocking.pass_surname(*_sides(spark, sf_dir), LinkConfig())


@query(f"{SQL}, {P2} SELECT * FROM p2")
def q06_block_given_suppressed(spark, sf_dir):
    return blocking.pass_given(*_sides(spark, sf_dir), LinkConfig())


@query(f"{SQL}, {P1}, {P2}, {P3} SELECT id_a, id_b, string_agg(p, ',' ORDER BY p) AS passes FROM (SELECT *, '1' AS p FROM p1 UNION ALL SELECT *, '2' FROM p2 UNION ALL SELECT *, '3' FROM p3) GROUP BY id_a, id_b")
def q07_block_family_cross(spark, sf_dir):
    return blocking.block(*_sides(spark, sf_dir), LinkConfig()).withColumn("passes", F.array_join(F.col("passes").cast("array<string>"), ","))


@query(f"{SQL}, {P1} SELECT coalesce(ko, 'none') AS ko, count(*) AS n FROM (SELECT CASE WHEN a.gender <> b.gender THEN 'gender' WHEN abs(a.birth_year - b.birth_year) > 10 THEN 'birthGap' WHEN a.birth_year - b.birth_year > 2 THEN 'ageRegression' WHEN a.seq = b.seq AND a.seq % 17 = 0 THEN 'isNotSameAs' WHEN a.seq % 19 = 0 THEN 'deathBefore1880' END AS ko FROM p1 JOIN a ON a.mention_id = id_a JOIN b ON b.mention_id = id_b) GROUP BY 1")
def q08_knockouts_stats(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    denied = a.where("seq_a % 17 = 0").select(F.concat(F.lit("SYN-CN-1880-"), "seq_a").alias("subject_id"), F.col("id_a").alias("object_id"))
    died = a.where("seq_a % 19 = 0").select("id_a")
    p = blocking.surname_records(blocking.marked(a, denied, died), b, LinkConfig())
    return blocking.knock_out(p, LinkConfig()).groupBy(F.coalesce("ko", F.lit("none")).alias("ko")).agg(F.count("*").alias("n"))


@query(f"{SQL}, {P1}, {LEVERS} SELECT id_a, id_b, rung, CAST(a_part AS DOUBLE) AS a_part, CAST(b_value AS DOUBLE) AS b_value, CAST(race_value AS DOUBLE) AS race_value, CAST(occ_value AS DOUBLE) AS occ_value, round(least(0.99, 1 / (1 + exp(-(-4.0 + a_part + b_value + race_value + occ_value)))), 9) AS confidence FROM y")
def q09_score_levers(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    c = LinkConfig()
    p = blocking.surname_records(scoring.with_rarity(a, a, c), b, c).withColumn("similar", F.lit(False)).withColumn("bridged", F.lit(False))
    p = p.withColumn("a", scoring.lever_a(c)).withColumn("b_value", scoring.lever_b(c)).withColumn("race_value", scoring.race_signal(c)).withColumn("occ_value", scoring.occupation_signal(c)).withColumn("c_value", F.lit(0.0)).withColumn("d_value", F.lit(0.0))
    p = scoring.confident(p, c)
    return p.select("id_a", "id_b", "a.rung", scoring.effective_a(F.lit(0.0)).alias("a_part"), "b_value", "race_value", "occ_value", F.round("confidence", 9).alias("confidence"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part) SELECT x.w AS name_a, y.w AS name_b FROM w x JOIN w y ON x.w < y.w WHERE jaro_winkler_similarity(x.w, y.w) >= 0.85")
def q10_jw_match(spark, sf_dir):
    return blocking.close_names(_t(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")), "w")


@query(f"""{SQL}, h AS (SELECT family_id, min(mention_id) AS hid FROM a WHERE head GROUP BY 1), hh AS (SELECT h.family_id, hid, a.gender AS hg, a.birth_year AS hb FROM h JOIN a ON a.mention_id = hid),
    s AS (SELECT family_id, min(mention_id) AS id FROM a JOIN hh USING (family_id) WHERE mention_id <> hid AND gender <> hg AND abs(birth_year - hb) <= 15 AND 1870 - birth_year >= 16 GROUP BY 1)
    SELECT id, 'spouse' AS kin FROM s UNION ALL SELECT mention_id, 'child' FROM a JOIN hh USING (family_id) WHERE mention_id <> hid AND birth_year - hb >= 13 AND mention_id NOT IN (SELECT id FROM s)""")
def q11_kin_inference(spark, sf_dir):
    r, c = records(spark, sf_dir), LinkConfig()
    s = family.inferred_spouses(r, c, 1870)
    return s.withColumn("kin", F.lit("spouse")).unionByName(family.inferred_children(r, s, c, 1870).select("id", F.lit("child").alias("kin")))


def _scored(spark, sf_dir):
    """All passes' pairs that no rule knocks out, scored."""
    a, b = _sides(spark, sf_dir)
    c = LinkConfig()
    none = spark.createDataFrame([], "subject_id string, object_id string")
    p = blocking.candidates(blocking.marked(scoring.prepared(a, b, c), none, a.limit(0).select("id_a")), b, c)
    p = scoring.score(blocking.knock_out(p, c).where("ko is null").drop("ko"), c)
    return scoring.confident(p.withColumn("c_value", F.lit(0.0)).withColumn("d_value", F.lit(0.0)).withColumn("spousal", F.lit(False)), c)


ALIGNED = "al AS (SELECT a.family_id, a.mention_id AS id_a, b.mention_id AS id_b, a.last_name AS f, b.last_name AS t, CASE WHEN a.seq % 5 = 0 THEN 1.2 ELSE 0.6 END AS gain FROM a JOIN b ON a.seq = b.seq)"


def _evidence(spark, sf_dir):
    """Evidence on given alignments: every person with their own later record."""
    a, b = _sides(spark, sf_dir)
    p = a.join(b, F.col("seq_a") == F.col("seq_b")).withColumn("spousal", F.col("seq_a") % 5 == 0)
    rows = F.sort_array(F.collect_list(F.struct("id_a", "id_b", "spousal", "last_a", "last_b"))).alias("chosen")
    return family.evidence(p.groupBy("family_id_a", "family_id_b").agg(rows), LinkConfig())


@query(f"{SQL}, {ALIGNED} SELECT id_a, id_b, round(least(2.4, CAST(sum(gain) OVER w - gain AS DOUBLE)), 9) AS c_new, round(least(2.4, CAST(sum(gain) OVER w AS DOUBLE)), 9) AS bundle_score, count(*) OVER w AS n_aligned FROM al WINDOW w AS (PARTITION BY family_id)")
def q12_lever_c_leave_one_out(spark, sf_dir):
    return _evidence(spark, sf_dir).select("id_a", "id_b", F.round("c_new", 9).alias("c_new"), F.round("bundle_score", 9).alias("bundle_score"), F.col("n_aligned").cast("long").alias("n_aligned"))


@query(f"""{SQL}, o AS (SELECT census_year, family_id, row_number() OVER (PARTITION BY census_year ORDER BY min(seq), family_id) - 1 AS place FROM r GROUP BY census_year, family_id),
    p AS (SELECT a.mention_id AS id_a, b.mention_id AS id_b, a.family_id AS fa, x.place AS oa, y.place AS ob, a.seq = b.seq AND a.seq % 2 = 0 AS won FROM a JOIN b ON b.seq = a.seq OR b.seq = a.seq + 1
          JOIN o x ON x.census_year = 1870 AND x.family_id = a.family_id JOIN o y ON y.census_year = 1880 AND y.family_id = b.family_id)
    SELECT p.id_a, p.id_b, count(*) AS d_count FROM p JOIN p w ON w.won AND w.oa BETWEEN p.oa - 15 AND p.oa + 15 AND w.ob BETWEEN p.ob - 15 AND p.ob + 15 AND w.fa <> p.fa AND w.id_b <> p.id_b GROUP BY ALL""")
def q13_lever_d_neighbors(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    c = LinkConfig()
    p = a.join(b, F.col("seq_a") == F.col("seq_b")).unionByName(a.join(b, F.col("seq_a") + 1 == F.col("seq_b")))
    placed = family.place_families(p.withColumn("confidence", F.lit(0.9)), family.family_order(records(spark, sf_dir)), c)
    winners = placed.join(a.join(b, F.col("seq_a") == F.col("seq_b")).where("seq_a % 2 = 0").select("id_a", "id_b"), ["id_a", "id_b"])
    return family.neighbour_counts(placed, winners, c).select("id_a", "id_b", F.col("d_count").cast("long").alias("d_count"))


@query(f"{SQL}, {ALIGNED} SELECT family_id, f AS drift_from, t AS drift_to, count(*) AS n FROM al WHERE f <> t GROUP BY ALL HAVING count(*) >= 3")
def q14_drift(spark, sf_dir):
    e = _evidence(spark, sf_dir).where("drift").join(_sides(spark, sf_dir)[0].select("id_a", F.col("family_id_a").alias("family_id")), "id_a")
    return e.groupBy("family_id", "drift_from", "drift_to").agg(F.count("*").alias("n"))


@query()
def align_families(spark, sf_dir):
    """Alignment of the pairs that blocking and scoring leave."""
    return family.align(_scored(spark, sf_dir), LinkConfig()).select("id_a", "id_b", "c_new", "bundle_score", "n_aligned", "drift")


@query()
def provisional_neighbors(spark, sf_dir):
    """Neighbours' evidence for the same pairs, with its provisional assignment."""
    return family.neighbours(_scored(spark, sf_dir), family.family_order(records(spark, sf_dir)), LinkConfig())


@query()
def q15_greedy_one_to_one(spark, sf_dir):
    p = _scored(spark, sf_dir).where("confidence >= 0.6").select("id_a", "id_b", "confidence")
    return matching.greedy_one_to_one(p, "id_a", "id_b", [-F.col("confidence"), F.concat_ws("|", "id_a", "id_b")])


LOCK = "SELECT l_orderkey AS l, l_partkey AS r, max(l_quantity) / 50 AS score FROM lineitem GROUP BY ALL"


@query(f"WITH e AS ({LOCK}), b AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS second FROM e WINDOW w AS (PARTITION BY l ORDER BY score DESC, r)), c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, l) AS k FROM b WHERE n = 1 AND score >= 0.8 AND score - second >= 0.05) SELECT l, r, score FROM c WHERE k = 1")
def q16_lock_pass(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("l"), F.col("l_partkey").alias("r")).agg((F.max("l_quantity") / 50).alias("score"))
    return matching.lock_pass(e, "l", "r", "score", [F.desc("score"), F.col("r")], [F.desc("score"), F.col("l")], 0.8)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS p FROM lineitem), t AS (SELECT x.l_orderkey, x.p AS best, coalesce((SELECT max(y.p) FROM s y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber <> 1), 0.0) AS second FROM s x WHERE l_linenumber = 1)
    SELECT l_orderkey, best, second, CASE WHEN best >= 0.8 THEN 'MATCH' WHEN best >= 0.55 AND best - second >= 0.15 AND second < 0.5 THEN 'MATCH' WHEN best >= 0.4 THEN 'MAYBE' ELSE 'UN-MATCHED' END AS status FROM t""")
def q17_classify(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("no_p"), F.col("l_linenumber").alias("id_c"), (F.col("l_quantity") / 50).alias("score"))
    t = verified.margins(s, s.where("id_c = 1"))
    return t.select(F.col("no_p").alias("l_orderkey"), F.col("score").alias("best"), "second", verified.classify(F.col("score"), F.col("second")).alias("status"))


# Fields of the name matcher, made in both engines.
NAMES = """SELECT mention_id, seq, family_id, census_year, CASE WHEN seq % 11 = 0 THEN '' WHEN seq % 17 = 3 THEN concat(first_name, substr(first_name, 2, 1)) ELSE first_name END AS first_name, CASE WHEN seq % 19 = 0 THEN '' ELSE last_name END AS last_name, nysiis,
    CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN concat(substr(nysiis, 1, 2), ':', substr(soundex, 1, 4)) ELSE concat(substr(nysiis, 1, 3), ':', substr(soundex, 1, 2)) END AS metaphone, birth_year, gender, race, head, occupation FROM {m}"""


def _names(spark, sf_dir) -> DataFrame:
    m = spark.sql(NAMES.format(m="{m}"), m=mentions(spark, sf_dir))
    full = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    return m.withColumnsRenamed({"nysiis": "nysiis_last_name", "metaphone": "metaphone_last_name"}).withColumn("full_name", full).withColumn("norm_first_name", F.lit(""))


@query(f"""{SQL}, nm AS ({NAMES.format(m='m')}), k AS (SELECT *, upper(first_name) AS g, CASE upper(first_name) WHEN 'SAM' THEN 'SAMUEL' WHEN 'NED' THEN 'EDWARD' WHEN 'BETSY' THEN 'ELIZABETH' WHEN 'WILLIE' THEN 'WILLIAM' WHEN 'KATE' THEN 'CATHERINE' ELSE upper(first_name) END AS c,
        trim(concat(first_name, ' ', last_name)) AS full_name, split_part(metaphone, ':', 1) AS mp, split_part(metaphone, ':', 2) AS ms FROM nm),
    p AS (SELECT x.mention_id AS id_a, y.mention_id AS id_b, x.g AS ga, y.g AS gb, x.c AS ca, y.c AS cb,
        CASE WHEN x.full_name <> '' AND x.full_name = y.full_name THEN 'EXACT_FULLNAME' WHEN x.last_name <> '' AND x.last_name = y.last_name THEN 'EXACT_LASTNAME'
             WHEN x.metaphone = '' OR y.metaphone = '' THEN CASE WHEN x.nysiis = y.nysiis THEN 'NYSIIS' ELSE 'NO_MATCH' END
             WHEN x.mp = y.mp THEN 'PHONETIC_STRONG' WHEN x.mp = y.ms OR x.ms = y.mp THEN 'PHONETIC_MODERATE' WHEN x.ms = y.ms THEN 'PHONETIC_WEAK' ELSE 'NO_MATCH' END AS kind
        FROM k x JOIN k y ON x.family_id = y.family_id AND x.census_year = 1870 AND y.census_year = 1880),
    s AS (SELECT *, CASE kind WHEN 'NO_MATCH' THEN 0 WHEN 'PHONETIC_WEAK' THEN 0.6 WHEN 'PHONETIC_MODERATE' THEN 0.8 WHEN 'NYSIIS' THEN 0.85 ELSE 1 END AS st, (ga = gb OR jaro_winkler_similarity(ga, gb) >= 0.85) AS sim FROM p)
    SELECT id_a, id_b, kind, CAST(CASE WHEN ga = '' OR gb = '' THEN CASE WHEN st >= 0.8 THEN 0.3 ELSE 0 END
        WHEN len(ga) > 1 AND len(gb) > 1 THEN CASE WHEN ca = cb AND st >= 0.8 THEN 1 WHEN sim AND st >= 0.8 THEN 0.85 WHEN (ca = cb OR sim) AND st = 0.6 THEN 0.7 WHEN (ca = cb OR sim) AND st = 0 THEN 0.4 WHEN st >= 0.8 THEN 0.3 ELSE 0 END
        WHEN st < 0.8 THEN 0 WHEN substr(ga, 1, 1) <> substr(gb, 1, 1) THEN 0.3 WHEN len(ga) = 1 AND len(gb) = 1 THEN 0.35 ELSE 0.55 END AS DOUBLE) AS name_score FROM s""")
def q18_matchname(spark, sf_dir):
    n = _names(spark, sf_dir)
    side = lambda y, t: n.where(F.col("census_year") == y).select("family_id", F.col("mention_id").alias(f"id_{t}"), *[v.alias(k) for k, v in schedule.name_columns(n, t).items()])
    p = schedule.name_scores(side(1870, "a").join(side(1880, "b"), "family_id"), "a", "b")
    return p.select("id_a", "id_b", F.col("surname.kind").alias("kind"), "name_score")


@query("""WITH e AS (SELECT event_id, month(ts) || '.' || day(ts) AS da, month(ts + INTERVAL 1 DAY * (event_id % 9)) || '.' || day(ts + INTERVAL 1 DAY * (event_id % 9)) AS db FROM events),
    d AS (SELECT *, CAST(split_part(da, '.', 1) AS INT) AS ma, CAST(split_part(da, '.', 2) AS INT) AS dda, CAST(split_part(db, '.', 1) AS INT) AS mb, CAST(split_part(db, '.', 2) AS INT) AS ddb, floor(abs(CAST(da AS DOUBLE) - CAST(db AS DOUBLE)) * 100 + 0.5) / 100 AS num FROM e),
    f AS (SELECT *, CASE WHEN ma = mb THEN abs(dda - ddb) ELSE abs(date_diff('day', make_date(1850, ma, 1) + CAST(dda - 1 AS INT), make_date(1850, mb, 1) + CAST(ddb - 1 AS INT))) END AS days FROM d)
    SELECT event_id, da, db, CAST(CASE WHEN days = 0 OR num = 0 THEN 0.5 WHEN days <= 1 OR num <= 0.1001 THEN 0.4 WHEN days <= 2 OR num <= 0.2001 THEN 0.3 WHEN days <= 7 OR num <= 0.7001 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS bonus FROM f""")
def q19_enumerator_bonus(spark, sf_dir):
    md = lambda c: F.concat(F.month(c).cast("string"), F.lit("."), F.dayofmonth(c).cast("string"))
    e = _t(spark, sf_dir, "events").select("event_id", md(F.col("ts")).alias("da"), md(F.date_add(F.to_date("ts"), (F.col("event_id") % 9).cast("int"))).alias("db"))
    return e.withColumn("bonus", S.enumerator_bonus(F.lit("Ann"), F.col("da"), F.lit("ann "), F.col("db")))


@query("WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, max(CASE WHEN n = 1 THEN o_orderkey END) AS mention1, max(CASE WHEN n = 2 THEN o_orderkey END) AS mention2, max(CASE WHEN n = 3 THEN o_orderkey END) AS mention3 FROM t WHERE n <= 3 GROUP BY 1")
def q20_top3_pivot(spark, sf_dir):
    return schedule.top_three(_t(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey"), [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("""WITH p AS (SELECT (event_id * 37 % 1000) / 1000.0 AS p FROM events), g AS (SELECT CASE WHEN p >= 0.99 THEN 'A' WHEN p >= 0.95 THEN 'B' WHEN p >= 0.9 THEN 'C' WHEN p >= 0.75 THEN 'D' WHEN p >= 0.5 THEN 'E' WHEN p >= 0.25 THEN 'F' WHEN p >= 0.1 THEN 'G' ELSE 'H' END AS stratum, count(*) AS n, avg(CAST(p AS DOUBLE)) AS mean FROM p GROUP BY 1)
    SELECT stratum, n, round(least(0.99, greatest(0.01, mean)), 9) AS pbar, round(n * sqrt(least(0.99, greatest(0.01, mean)) * (1 - least(0.99, greatest(0.01, mean)))), 6) AS weight FROM g""")
def q21_neyman_allocation(spark, sf_dir):
    p = _t(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37 % 1000) / 1000.0).alias("probability"))
    return sampling.strata(p).select("stratum", "n", F.round("pbar", 9).alias("pbar"), F.round("weight", 6).alias("weight"))


@query()
def q21b_neyman_sample(spark, sf_dir):
    p = _t(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37 % 1000) / 1000.0).alias("probability"))
    return sampling.neyman_sample(p, "event_id").select("event_id", "probability", "stratum")


@query("""WITH s AS (SELECT event_id AS n, event_id - event_id % 2 * (event_id % 3) AS line, CASE WHEN event_id % 5 = 0 THEN 'Owner' ELSE '' END AS status, 'owner ' || user_id AS full_name FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n) AS again, sum(CASE WHEN status = 'Owner' THEN 1 ELSE 0 END) OVER w AS hh, last_value(CASE WHEN status = 'Owner' THEN full_name END IGNORE NULLS) OVER w AS owner_name FROM s WINDOW w AS (ORDER BY n ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, 'ALB-SS-1850-' || line || CASE WHEN again > 1 THEN '.' || again ELSE '' END AS mention_id FROM d), f AS (SELECT full_name AS owner_name, arg_min(mention_id, n) AS owner_id FROM e WHERE status = 'Owner' GROUP BY 1)
    SELECT n, mention_id, CASE WHEN hh > 0 THEN 'HS1850-' || hh ELSE '' END AS household_id, CASE WHEN status <> 'Owner' THEN owner_id END AS owner_id FROM e LEFT JOIN f USING (owner_name) WHERE NOT (status = 'Owner' AND mention_id <> owner_id)""")
def q22_carry_forward_household(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("n"), (F.col("event_id") - F.col("event_id") % 2 * (F.col("event_id") % 3)).alias("line"), F.when(F.col("event_id") % 5 == 0, "Owner").otherwise("").alias("status"), F.concat(F.lit("owner "), F.col("user_id").cast("string")).alias("full_name"))
    return files.schedule_households(e, "ALB", 1850).select("n", "mention_id", "household_id", "owner_id")


# Lines of a dump, made in both engines: an INSERT every fifty lines, an end to it, tuples between.
LINES = r"""SELECT event_id AS n, CASE WHEN event_id % 50 = 0 THEN concat('INSERT INTO `', CASE floor(event_id / 50) % 3 WHEN 0 THEN 'population_census' WHEN 1 THEN 'slave_census' ELSE 'places' END, '` (`id`, `county`, `year`, `name`) VALUES')
    WHEN event_id % 50 = 49 THEN 'UNLOCK TABLES;' ELSE concat('(', event_id, ',''', CASE WHEN user_id % 2 = 0 THEN 'Augusta' ELSE 'Rock{q}bridge' END, ''', ', 1860 + 10 * (event_id % 3), ',', CASE WHEN event_id % 7 = 0 THEN ' NULL ' ELSE concat('''', event_type, ''', ''a, b''') END, ')', CASE WHEN event_id % 2 = 0 THEN ',' ELSE ';' END) END AS value FROM {events}"""
LINES_SQL = LINES.format(events="events", q="''''")
TABLED = f"l AS ({LINES_SQL}), t AS (SELECT n, value, CASE WHEN value LIKE 'UNLOCK%' THEN '' ELSE nullif(regexp_extract(value, '^INSERT INTO `([^`]+)`', 1), '') END AS mark FROM l), d AS (SELECT n, value, last_value(mark IGNORE NULLS) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS \"table\" FROM t), r AS (SELECT * FROM d WHERE value LIKE '(%' AND \"table\" <> '')"


def _lines(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    head = F.concat(F.lit("INSERT INTO `"), F.element_at(F.array(F.lit("population_census"), F.lit("slave_census"), F.lit("places")), (F.floor(F.col("event_id") / 50) % 3 + 1).cast("int")), F.lit("` (`id`, `county`, `year`, `name`) VALUES"))
    county = F.when(F.col("user_id") % 2 == 0, "Augusta").otherwise("Rock''bridge")
    last = F.when(F.col("event_id") % 7 == 0, " NULL ").otherwise(F.concat(F.lit("'"), "event_type", F.lit("', 'a, b'")))
    row = F.concat(F.lit("("), F.col("event_id").cast("string"), F.lit(",'"), county, F.lit("', "), (1860 + 10 * (F.col("event_id") % 3)).cast("string"), F.lit(","), last, F.lit(")"), F.when(F.col("event_id") % 2 == 0, ",").otherwise(";"))
    return e.select(F.col("event_id").alias("n"), F.when(F.col("event_id") % 50 == 0, head).when(F.col("event_id") % 50 == 49, "UNLOCK TABLES;").otherwise(row).alias("value"))


@query(f"WITH {TABLED} SELECT \"table\", count(*) AS n, count(*) FILTER (WHERE contains(value, '1880')) AS n_year, count(*) FILTER (WHERE contains(\"table\", 'census') AND contains(lower(value), 'augusta') AND contains(value, '1880')) AS n_county_year FROM r GROUP BY 1")
def q23_dump_counts(spark, sf_dir):
    return files.table_counts(_lines(spark, sf_dir))


@query(f"WITH {TABLED} SELECT lower(regexp_extract(value, '^\\((\\d+),\\s*''([^'']+)'',\\s*(\\d+)', 2)) AS county, regexp_extract(value, '^\\((\\d+),\\s*''([^'']+)'',\\s*(\\d+)', 3) AS year, count(*) AS n FROM r WHERE \"table\" = 'population_census' AND regexp_matches(value, '^\\((\\d+),\\s*''([^'']+)'',\\s*(\\d+)') GROUP BY 1, 2")
def q23b_county_counts(spark, sf_dir):
    return files.county_counts(_lines(spark, sf_dir))


@query(f"""WITH {TABLED} SELECT n, "table", concat_ws('|', CAST(n AS VARCHAR), CASE WHEN user_id % 2 = 0 THEN 'Augusta' ELSE 'Rock''bridge' END, CAST(1860 + 10 * (n % 3) AS VARCHAR), CASE WHEN n % 7 = 0 THEN '' ELSE concat(event_type, '|a, b') END) AS cells FROM r JOIN events ON event_id = n""")
def q23c_dump_rows(spark, sf_dir):
    return files.dump_rows(_lines(spark, sf_dir)).select("n", "table", F.array_join("values", "|").alias("cells"))


@query("""SELECT c_name AS name, CAST(c_custkey % 80 AS VARCHAR) AS age, 'F' AS sex, c_mktsegment AS color, CAST((4 + c_custkey % 3) * 12 + c_custkey % 12 AS VARCHAR) || '.0' AS height, CAST(c_custkey AS VARCHAR) AS registration_number,
    '4 May ' || (1790 + c_custkey % 60) AS registration_date, 'scar on left hand' AS additional_info, CAST(1790 + c_custkey % 60 AS INT) AS registration_year, CAST(1790 + c_custkey % 60 - c_custkey % 80 AS INT) AS birth_year FROM customer""")
def q24_registry_extract(spark, sf_dir):
    k = F.col("c_custkey")
    t = lambda x: x.cast("string")
    record = F.concat(F.lit("Name: "), "c_name", F.lit("\nAge: "), t(k % 80), F.lit("\nSex: F\nColor: "), "c_mktsegment", F.lit("\nHeight: "), t(4 + k % 3), F.lit(" ft "), t(k % 12), F.lit(" in\nRegistration number: "), t(k), F.lit("\nRegistration Date: 4 May "), t(1790 + k % 60), F.lit("\nAdditional Info: scar on\nleft hand"))
    # Each record stands twice in its text, once after a page number.
    return files.registry_rows(_t(spark, sf_dir, "customer").select(F.concat(F.lit("Register\n"), record, F.lit("\n12/"), record).alias("text")))


@query(r"""WITH n AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'CAPT ' WHEN 2 THEN 'Lt. Col. ' WHEN 3 THEN 'Drake ' WHEN 4 THEN 'MRS' ELSE 'ens ltc.' END || CASE WHEN turn % 6 = 4 THEN '' ELSE text END AS t FROM conversations),
    s AS (SELECT conv_id, turn, regexp_replace(t, '^(?i:(1SGT|CAPT|CORP|COL|CPL|CPT|ENS|GEN|LTC|MAJ|MRS|PFC|PVT|REV|SGT|DR|LT|MR)([. ]+|$))+', '') AS t FROM n)
    SELECT conv_id, turn, trim(regexp_replace(replace(regexp_replace(t, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s''"“”‘’]', '', 'g'), '_', ''), '\s+', ' ', 'g')) AS name FROM s""".replace("\\\\", "\\"))
def q25_name_prefix_clean(spark, sf_dir):
    title = F.element_at(F.array(*[F.lit(x) for x in ("Dr. ", "CAPT ", "Lt. Col. ", "Drake ", "MRS", "ens ltc.")]), (F.col("turn") % 6 + 1).cast("int"))
    name = F.concat(title, F.when(F.col("turn") % 6 == 4, "").otherwise(F.col("text")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", S.strip_punctuation(S.strip_prefixes(name)).alias("name"))


@query("WITH p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events), c AS (SELECT place AS centre FROM p WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY user_id)) SELECT event_id, place - centre AS \"offset\", centre FROM p JOIN c ON place BETWEEN centre - 12 AND centre + 12")
def q26_context_window(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    hits = e.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    w = blocking.context_window(e.select("event_id", "ts"), ["ts", "event_id"], hits, ["event_id"])
    return w.select("event_id", F.col("offset").cast("long").alias("offset"), F.col("centre").cast("long").alias("centre"))


@query()
def q27_label_calibration(spark, sf_dir):
    """Name calibration on labelled documents, their length as the score: each score with its probability."""
    d = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.round(F.least(F.lit(2.0), F.col("n_chars") / 5000), 3).alias("score"), "quality")
    model = calibration.fit_names(calibration.score_counts(d, "score", "quality"))
    return d.groupBy("score").agg(F.count("*").alias("n")).withColumn("probability", F.round(model.probability(F.col("score")), 6))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\\s')) AS links, (regexp_extract_all(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\b\\d{4}\\b'))[1] AS birth_year, (regexp_extract_all(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\b\\d{4}\\b'))[2] AS death_year FROM pages")
def q28_html_listing_parse(spark, sf_dir):
    return files.page_titles(_t(spark, sf_dir, "pages"))


@query("""SELECT '-' AS hitl_match, CASE WHEN o_orderstatus = 'F' THEN 'MATCH' ELSE 'MAYBE' END AS status, printf('%.3f', (o_orderkey % 1000) / 1000.0) AS probability, o_orderpriority || ' : ' || o_orderstatus AS full_name, o_custkey || ' : ' || o_orderkey AS birth_year,
    'M : ' AS gender, 'B : W' AS norm_race, 'm' || o_custkey AS mention_id, 'p' || o_orderkey AS person_id, '{"note":"' || o_orderstatus || '"}' AS why FROM orders""")
def q29_hitl_export(spark, sf_dir):
    o, t = _t(spark, sf_dir, "orders"), lambda c: F.col(c).cast("string")
    side = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    e = F.lit("")
    found = o.select(
        F.lit("-").alias("hitl_match"), F.when(F.col("o_orderstatus") == "F", "MATCH").otherwise("MAYBE").alias("status"), ((F.col("o_orderkey") % 1000) / 1000.0).alias("probability"), F.struct(F.col("o_orderstatus").alias("note")).alias("why"),
        side(mention_id=F.concat(F.lit("m"), t("o_custkey")), person_id=e, full_name=F.col("o_orderpriority"), birth_year=t("o_custkey"), gender=F.lit("M"), norm_race=e, race=F.lit("B")).alias("candidate"),
        side(mention_id=e, person_id=F.concat(F.lit("p"), t("o_orderkey")), full_name=F.col("o_orderstatus"), birth_year=t("o_orderkey"), gender=e, norm_race=F.lit("W"), race=e).alias("person"),
    )
    return verified.review_rows(found)


@query("SELECT DISTINCT text, lang, source FROM documents")
def q30_exact_dedupe_union(spark, sf_dir):
    return files.unique_rows(_t(spark, sf_dir, "documents").select("text", "lang", "source"))


def _people(spark, sf_dir) -> DataFrame:
    """The stand-in as a mentions file of one county."""
    m = _names(spark, sf_dir)
    return m.select("mention_id", "full_name", "first_name", F.lit("").alias("middle_name"), "last_name", "norm_first_name", "nysiis_last_name", "metaphone_last_name", "gender", "race", F.col("race").alias("norm_race"), "head", F.concat_ws("-", "census_year", "family_id").alias("household_id"), F.col("birth_year").cast("string").alias("birth_year"), F.when(F.col("seq") % 23 == 0, F.lit("1875")).otherwise("").alias("death_year"), F.col("occupation").alias("district"), F.lit("Ann").alias("enumerator"), F.concat(F.lit("6."), (F.col("seq") % 28 + 1).cast("string")).alias("enumerator_date"), F.lit(None).cast("string").alias("original_data"), F.concat(F.lit("SYN-CN-"), "census_year").alias("source"), "seq", "census_year")


@query(f"""{SQL}, nm AS ({NAMES.format(m='m')}), k AS (SELECT *, split_part(metaphone, ':', 1) AS mp, split_part(metaphone, ':', 2) AS ms, upper(trim(regexp_replace(concat(first_name, last_name), '[^a-z]', '', 'g'))) AS fk FROM nm),
    x AS (SELECT * FROM k WHERE census_year = 1870 AND seq % 23 <> 0), y AS (SELECT * FROM k WHERE census_year = 1880),
    c AS (SELECT x.mention_id AS id_p, y.mention_id AS id_c FROM x JOIN y ON x.last_name = y.last_name AND x.last_name <> '' UNION SELECT x.mention_id, y.mention_id FROM x JOIN y ON x.nysiis = y.nysiis UNION SELECT x.mention_id, y.mention_id FROM x JOIN y ON x.fk = y.fk AND x.fk <> ''
      UNION SELECT p.mention_id, q.mention_id FROM (SELECT mention_id, unnest([mp, ms]) AS z FROM x) p JOIN (SELECT mention_id, unnest([mp, ms]) AS z FROM y) q ON p.z = q.z AND p.z <> '')
    SELECT id_p, id_c FROM c JOIN x ON x.mention_id = id_p JOIN y ON y.mention_id = id_c WHERE (x.gender = y.gender OR x.gender IS NULL OR y.gender IS NULL) AND ((x.race = 'W') = (y.race = 'W')) AND (abs(x.birth_year - y.birth_year) <= 12 OR x.birth_year IS NULL OR y.birth_year IS NULL)""")
def q31_verified_blocking(spark, sf_dir):
    m = _people(spark, sf_dir).withColumn("row_no", F.col("seq"))
    persons, pool = m.where("census_year = 1870").withColumn("person_id", F.lit("")), m.where("census_year = 1880").withColumn("death_year", F.lit(""))
    return verified.blocked(persons, pool, 1880, verified.VerifiedConfig())[0].select("id_p", "id_c")


@query("""WITH f AS (SELECT CASE WHEN o_totalprice >= 250000 THEN 'MATCH' WHEN o_totalprice >= 100000 THEN 'MAYBE' ELSE 'UN-MATCHED' END AS status FROM orders) SELECT status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM f), 1) AS percent FROM f GROUP BY 1""")
def q32_status_counts(spark, sf_dir):
    p = F.col("o_totalprice")
    return verified.status_counts(_t(spark, sf_dir, "orders").select(F.when(p >= 250000, "MATCH").when(p >= 100000, "MAYBE").otherwise("UN-MATCHED").alias("status")))


@query()
def match_verified(spark, sf_dir):
    m = _people(spark, sf_dir)
    persons = m.where("census_year = 1870").withColumn("person_id", F.concat(F.lit("SYN-VP-"), F.col("seq").cast("string")))
    found = verified.match_verified(persons, m.where("census_year = 1880").withColumn("death_year", F.lit("")), "SYN", 1880, ["seq"])
    return verified.review_rows(found)


@query(f"WITH m AS ({MENTIONS.format(orders='orders')}), h AS (SELECT family_id, count(*) AS n FROM m WHERE census_year = 1870 GROUP BY 1) SELECT mention_id, concat('SYN-VP-SS-1870-', '1870-', family_id) AS candidate_id, CAST(greatest(0, n - 1) AS BIGINT) AS household_count FROM m JOIN h USING (family_id) WHERE census_year = 1870 AND head")
def q33_enslavers(spark, sf_dir):
    m = _people(spark, sf_dir).where("census_year = 1870").withColumn("source", F.lit("SYN-SS-1870"))
    return schedule.enslavers(m, "SYN", 1870).select("mention_id", "candidate_id", "household_count")


@query()
def link_decennial(spark, sf_dir):
    m = mentions(spark, sf_dir).withColumnsRenamed({"nysiis": "nysiis_last_name", "soundex": "soundex_last_name", "occupation": "norm_occupation"})
    none = spark.createDataFrame([], "subject_id string, predicate string, object_id string")
    return decennial.link_decennial(m, none).links.select("subject_id", "object_id", "confidence", "tier", "evidence_bundle_id")


@query()
def match_schedule(spark, sf_dir):
    m = _people(spark, sf_dir).where("census_year = 1870")
    ss, cn = m.where("head").withColumn("source", F.lit("SYN-SS-1860")), m.where("not head").withColumn("source", F.lit("SYN-CN-1860"))
    found = schedule.match_schedule(schedule.enslavers(ss, "SYN", 1860), schedule.census_candidates(cn, "SYN", 1860), calibration.fit_names())
    return schedule.export_rows(found)


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phonetic blocking, name, birth and race evidence, and each earlier person's best candidate."""
    p = _scored(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("confidence"), "id_b"))
    return p.withColumn("n", n).where("n = 1").select("id_a", "id_b", "a.rung", "score", "confidence")
