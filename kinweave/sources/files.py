"""Readers, shapers and writers: CSV with every column as text, dumps, registries, listings, schedules."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions import scalars as S
from kinweave.operators.ordered import running

# -- CSV -------------------------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted CSV file with header: all columns text, header trimmed and without byte-order mark, blank cells null."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def first_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several files that is there and has rows."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            df = read_csv(spark, p)
            if not df.isEmpty():
                return df
    raise FileNotFoundError(", ".join(paths))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A CSV file with header; with `order` its rows are sorted, in as many part files as there are ranges."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def link_rows(links: DataFrame) -> DataFrame:
    """The eight columns of the link file."""
    return links.select("assertion_id", "subject_id", "predicate", "object_id", "start_year", "end_year", F.lit("70-80").alias("who"), "confidence")


def write_links(links: DataFrame, path: str) -> None:
    write_csv(link_rows(links), path, ["subject_id"])


# -- SQL dumps -------------------------------------------------------------------------------------------------------


def parse_tuples(line: Column) -> Column:
    """Values of a line's SQL tuple: quoted ones with backslash and doubled-quote escapes, NULL as empty, others trimmed."""
    inner = F.regexp_replace(F.regexp_replace(line, r"^\s*\(?\s*", ""), r"\s*(?:\)[,;]?)?\s*$", "")
    # One match for each value with its comma, and an empty one at the end.
    cells = F.regexp_extract_all(inner, F.lit(r"(?s)\s*(?:'(?:[^'\\]|\\.|'')*+'?[^,]*|[^,]*)(?:,|$)"), F.lit(0))
    cells = F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0)))

    def unescape(body: Column) -> Column:
        # Cut at escaped backslashes, so that no other escape can begin inside one.
        def piece(x: Column) -> Column:
            x = F.replace(x, F.lit("''"), F.lit("'"))
            for sign, char in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("0", "\0")):
                x = F.replace(x, F.lit("\\" + sign), F.lit(char))
            return F.regexp_replace(x, r"(?s)\\(.)", "$1")

        return F.array_join(F.transform(F.split(body, r"\\\\"), piece), "\\")

    def value(cell: Column) -> Column:
        bare = F.trim(F.regexp_replace(cell, ",$", ""))
        body = F.regexp_extract(cell, r"(?s)^\s*'((?:[^'\\]|\\.|'')*+)", 1)
        return F.when(F.ltrim(cell).startswith("'"), unescape(body)).when(F.upper(bare) == "NULL", "").otherwise(bare)

    return F.transform(cells, value)


def dump_lines(lines: DataFrame) -> DataFrame:
    """Tuple lines of a dump (`n` line number, `value` text) with the table and columns of the INSERT before them.

    A table's tuples end where an UNLOCK, DROP or CREATE line begins.
    """
    insert = r"INSERT INTO `([^`]+)`(?: \(([^)]+)\))?"
    name = F.regexp_extract("value", insert, 1)
    columns = F.transform(F.split(F.regexp_extract("value", insert, 2), ","), lambda c: F.regexp_replace(c, "[ `]", ""))
    state = F.when(F.col("value").startswith("INSERT INTO"), F.struct(name.alias("table"), columns.alias("columns")))
    state = state.when(F.col("value").rlike("^(UNLOCK TABLES|DROP TABLE|CREATE TABLE)"), F.struct(F.lit("").alias("table"), F.array().cast("array<string>").alias("columns")))
    d = running(lines.select("n", "value"), ["n"], lasts={"state": state})
    return d.where(F.col("value").rlike(r"^\s*\(") & (F.col("state.table") != "")).select("n", "state.table", "state.columns", "value")


def dump_rows(lines: DataFrame) -> DataFrame:
    """n, table, columns, values of a dump's tuples."""
    return dump_lines(lines).select("n", "table", "columns", parse_tuples(F.col("value")).alias("values"))


def census_extract(lines: DataFrame, county: str, year: int, table: str = "population_census") -> DataFrame:
    """The rows of one county and year, under the dump's own column names (its first INSERT has them)."""
    whole = dump_rows(lines).where((F.col("table") == table) & (F.size("values") >= 3))
    rows = whole.where((F.lower(F.get("values", F.lit(1))) == county.lower()) & (F.get("values", F.lit(2)) == str(year)))
    head = whole.agg(F.min_by("columns", "n")).first()
    return rows.select("n", *[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(head[0] or [])])


def table_counts(lines: DataFrame, year: str = "1880", county: str = "augusta") -> DataFrame:
    """For each table: tuples, tuples that hold `year`, and those of census tables that hold `county` and `year`."""
    d = dump_lines(lines)
    has = F.col("value").contains(year)
    both = F.col("table").contains("census") & F.lower("value").contains(county) & has
    return d.groupBy("table").agg(F.count("*").alias("n"), F.count_if(has).alias("n_year"), F.count_if(both).alias("n_county_year"))


def county_counts(lines: DataFrame, table: str = "population_census") -> DataFrame:
    """county, year, n of a table's tuples that begin with a number, a quoted county and a year."""
    p = r"^\s*\((\d+),\s*'([^']+)',\s*(\d+)"
    d = dump_lines(lines).where(F.col("table") == table).where(F.col("value").rlike(p))
    return d.groupBy(F.lower(F.regexp_extract("value", p, 2)).alias("county"), F.regexp_extract("value", p, 3).alias("year")).agg(F.count("*").alias("n"))


# -- registries ------------------------------------------------------------------------------------------------------


def registry_rows(text: DataFrame) -> DataFrame:
    """Registry text (column `text`) to rows: one per record, exact repeats once.

    A label without a value takes the next line's text, as the source's layout does.
    """
    records = text.select(F.explode(F.split("text", r"\n(?=(?:[0-9/]+)?Name:\s)")).alias("r")).where(F.col("r").contains("Name:"))
    get = lambda label: F.trim(F.regexp_extract("r", rf"{label}:\s*(.*)", 1))
    info = F.regexp_extract("r", r"(?i)Additional Info:\s*([\s\S]*?)(?=\n[A-Za-z\s]+:|\z)", 1)
    out = records.select(
        get("Name").alias("name"),
        get("Age").alias("age"),
        get("Sex").alias("sex"),
        get("Color").alias("color"),
        S.height_in_inches(get("Height")).alias("height"),
        get("(?i)Registration number").alias("registration_number"),
        get("(?i)Registration date").alias("registration_date"),
        F.trim(F.replace(info, F.lit("\n"), F.lit(" "))).alias("additional_info"),
    )
    out = out.withColumn("registration_year", S.first_year(F.col("registration_date")))
    born = (F.col("registration_year") - F.col("age").try_cast("double")).cast("int")
    return unique_rows(out.withColumn("birth_year", born))


def unique_rows(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows that are equal in every column (or in `keys`) once, with map-side combine."""
    return rows.dropDuplicates(keys) if keys else rows.dropDuplicates()


# -- schedules -------------------------------------------------------------------------------------------------------

SCHEDULE_MENTION = ("mention_id", "source", "full_name", "first_name", "middle_name", "last_name", "age", "birth_year", "gender", "race", "head", "legal_status", "household_id")
SCHEDULE_ASSERTION = ("subject", "predicate", "object", "who", "start_year", "end_year", "confidence")


def schedule_households(rows: DataFrame, county: str, year: int) -> DataFrame:
    """Household and owner of each schedule row (`n`, `line`, `status`, `full_name`), carried down the file.

    Repeated lines get .2, .3; an owner seen before opens a new household but stays the same person.
    """
    owner = F.trim(F.coalesce("status", F.lit(""))) == "Owner"
    base = F.concat(F.lit(f"{county}-SS-{year}-"), F.col("line").cast("string"))
    again = F.row_number().over(Window.partitionBy("line").orderBy("n"))
    d = rows.withColumn("full_name", F.trim("full_name")).withColumn("mention_id", F.when(again == 1, base).otherwise(F.concat(base, F.lit("."), again.cast("string"))))
    d = running(d, ["n"], sums={"household": F.when(owner, 1).otherwise(0)}, lasts={"owner_name": F.when(owner, F.col("full_name"))})
    d = d.withColumn("household_id", F.when(F.col("household") > 0, F.concat(F.lit(f"HS{year}-"), F.col("household").cast("string"))).otherwise(F.lit("")))
    firsts = d.where(owner).groupBy(F.col("full_name").alias("owner_name")).agg(F.min_by("mention_id", "n").alias("owner_id"))
    d = d.join(firsts, "owner_name", "left").withColumn("is_owner", owner)
    return d.where(~F.coalesce(F.col("is_owner") & (F.col("mention_id") != F.col("owner_id")), F.lit(False))).withColumn("owner_id", F.when(~F.col("is_owner"), F.col("owner_id"))).drop("household", "owner_name")


def schedule_mentions(households: DataFrame, county: str, year: int) -> DataFrame:
    """The thirteen columns of the mentions file; owners have no age, year, gender and race."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in households.columns else F.lit("")
    own = lambda c: F.when(F.col("is_owner"), F.lit("")).otherwise(text(c))
    made = {"source": F.lit(f"{county}-SS-{year}"), "head": F.when(F.col("is_owner"), "Y").otherwise(""), "legal_status": F.when(F.col("is_owner"), "").otherwise("E")}
    made |= {c: own(c) for c in ("age", "birth_year", "gender", "race")}
    return households.select("n", *[made.get(c, text(c)).alias(c) for c in SCHEDULE_MENTION])


def schedule_assertions(households: DataFrame, year: int) -> DataFrame:
    """The seven columns of the assertions file."""
    d = households.where("owner_id is not null")
    return d.select("n", F.col("mention_id").alias("subject"), F.lit("wasEnslavedBy").alias("predicate"), F.col("owner_id").alias("object"), F.lit("SS").alias("who"), F.lit(str(year)).alias("start_year"), F.lit("").alias("end_year"), F.lit("0.83").alias("confidence"))


# -- listings, grids, cleaning ---------------------------------------------------------------------------------------


class _Items(HTMLParser):
    """Name, dates and place of each listed item, by the classes of their elements."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, frozenset[str]]] = []
        self.items: list[dict[str, list[str]]] = []
        self.done: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            classes = frozenset((dict(attrs).get("class") or "").split())
            if "memorial-item" in classes:
                self.items.append({"name": [], "dates": [], "place": []})
                self.done = set()
            self.open.append((tag, classes))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for _, classes in self.open[i:]:
                    self.done |= {k for k in ("name-grave", "birthDeathDates", "addr-cemet") if k in classes}
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        inside = [c for _, c in self.open]
        if not any("memorial-item" in c for c in inside) or not data.strip():
            return
        at = lambda k: next((i for i, c in enumerate(inside) if k in c), None) if k not in self.done else None
        name = at("name-grave")
        if name is not None and not any(t == "div" for t, _ in self.open[name + 1 :]):
            self.items[-1]["name"].append(data.strip())
        if at("birthDeathDates") is not None:
            self.items[-1]["dates"].append(data.strip())
        if at("addr-cemet") is not None and at("memorial-item---cemet") is not None:
            self.items[-1]["place"].append(data.strip())


def listing_items(html: Column) -> Column:
    """Array of struct name, dates, place of a listing page."""
    @F.pandas_udf("array<struct<name:string,dates:string,place:string>>")
    def run(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> list[dict]:
            p = _Items()
            p.feed(page or "")
            return [{"name": " ".join(x["name"]), "dates": "".join(x["dates"]), "place": " ".join(x["place"])} for x in p.items]

        return pages.map(one)

    return run(html)


def listing_rows(pages: DataFrame) -> DataFrame:
    """line, full_name, birth_year, death_year, location of listing pages (`page_id`, `html`), in page order."""
    d = pages.select("page_id", F.posexplode(listing_items(F.col("html"))).alias("item", "x"))
    years = F.regexp_extract_all("x.dates", F.lit(r"\b(\d{4})\b"), F.lit(1))
    year = lambda i: F.coalesce(F.get(years, F.lit(i)), F.lit(""))
    d = d.select("page_id", "item", S.strip_punctuation(S.strip_prefixes(F.col("x.name"), bare=False)).alias("full_name"), year(0).alias("birth_year"), year(1).alias("death_year"), S.strip_punctuation(F.col("x.place")).alias("location"))
    return numbered_rows(d, ["page_id", "item"], ["full_name", "birth_year", "death_year", "location"])


def page_titles(pages: DataFrame) -> DataFrame:
    """page_id, title, links, and the years in the title, of any pages."""
    years = F.regexp_extract_all("title", F.lit(r"\b(\d{4})\b"), F.lit(1))
    d = pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("links"))
    return d.select("page_id", "title", "links", F.get(years, F.lit(0)).alias("birth_year"), F.get(years, F.lit(1)).alias("death_year"))


def numbered_rows(rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """`line` from 1 and `fields`, of the rows in which any field is not empty."""
    some = rows.where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in fields]).isNotNull())
    return running(some, order, place="line").select("line", *fields)


def clean_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """A names file cleaned: titles and punctuation gone, empty rows left out, the others numbered anew."""
    name, place = S.strip_punctuation(S.strip_prefixes(F.coalesce("full_name", F.lit("")))), S.strip_punctuation(F.coalesce("location", F.lit("")))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = rows.select(*order, name.alias("full_name"), blank("birth_year").alias("birth_year"), blank("death_year").alias("death_year"), place.alias("location"))
    return numbered_rows(d, order, ["full_name", "birth_year", "death_year", "location"])


# Columns of a scraped grid.
GRID = ("full_name", "maiden_name", "gender", "race", "residence_age", "death_age", "birth_date", "birth_place", "residence_place", "death_date", "enslaver", "enslaved_person", "father", "mother", "spouse", "child", "occupation", "status", "notes")


def grid_rows(rows: DataFrame, pages: int = 3) -> DataFrame:
    """Scraped rows (`page`, `n`, `cells` array) of the first `pages` pages as numbered records of nineteen fields."""
    clean = ("full_name", "birth_place", "residence_place")
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    d = rows.where(F.col("page") <= pages).select("page", "n", *[(S.strip_punctuation(cell(i)) if c in clean else cell(i)).alias(c) for i, c in enumerate(GRID)])
    return numbered_rows(d, ["page", "n"], list(GRID))


def all_fields(rows: DataFrame, leave_out: tuple[str, ...] = ("original_data",)) -> DataFrame:
    """Column `fields`: a map of the row's columns and its original_data (JSON) that have a value; the row's own win."""
    own = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(c).cast("string") for c in rows.columns]))
    more = F.coalesce(F.from_json("original_data", "map<string,string>"), F.create_map().cast("map<string,string>"))
    has = lambda k, v: (F.trim(v) != "") & ~k.isin(*leave_out)
    own = F.map_filter(own, has)
    return rows.withColumn("fields", F.map_concat(own, F.map_filter(more, lambda k, v: has(k, v) & ~F.map_contains_key(own, k))))
