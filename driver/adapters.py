"""The given tables read as the tables of the race model.

Suppliers are races, shipping years are seasons, line items are startlist entries and results,
nations are teams, customers are riders, parts are planned races, events are race intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echelon.constants import EXECUTION_RULES, PARTICIPATION_RULES, PROFILE_AXES
from echelon.functions.columns import map_literal, normalised_map
from echelon.functions.dates import status_as_of
from echelon.operators import editions as ed
from echelon.operators.profiles import with_inferred_archetype
from echelon.operators.spread import checkpointed, shuffled
from echelon.operators.team_calendar import prepare_planning, with_overlap_groups

PLANNING_YEAR = 2001
AS_OF = "2001-06-30"


# Schemas of the given tables: reading with them needs no inference job.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate {ts}, o_orderpriority string",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate {ts}"
    ),
    "events": "event_id long, ts {ts}, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name].format(ts="timestamp_ntz")).parquet(f"{folder}/{name}.parquet")


def _percent(c: str) -> Column:
    """`round(c * 100)`, halves away from zero, without the detour over decimal text that `round` takes for each double."""
    share = F.col(c) * 100
    even = F.rint(share)
    return (even + F.when(share - even == F.signum(share) / 2, F.signum(share)).otherwise(F.lit(0.0))).cast("int")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as startlist rows of (race, season)."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("race_id"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.col("l_shipdate").cast("date").alias("day"),
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.col("l_extendedprice").alias("points"),
        F.col("l_quantity").alias("starts"),
        _percent("l_discount").alias("wins"),
        _percent("l_tax").alias("podiums"),
        F.col("l_linenumber").alias("top10s"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    """Sums to six decimals, so that equal sums stay equal whatever the order of addition."""
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema.fields if f.dataType.typeName() == "double"})


def list_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All result lists (flag N), stage lists (flag A, by line number) and startlists (all rows), summarised in one go.

    One row per list; written, since every kind of list is taken from it.
    """
    rows = lines(spark, folder)
    career = [F.col(c) for c in ("starts", "wins", "podiums", "top10s")]
    flag = F.col("l_returnflag")
    # lists are sorted and grouped by number and named at the end
    kinds = F.array(*map(F.lit, ("start", "gc", "stage")))
    entry = lambda kind, stage, value: F.struct(kind.alias("list"), stage.alias("stage"), value.alias("value"))
    result = entry(F.when(flag == "N", 2).otherwise(3), F.when(flag == "A", F.col("l_linenumber")).otherwise(0), F.col("points"))
    start = entry(F.lit(1), F.lit(0), ed.rider_form(*career))
    listed = rows.select("*", F.explode(F.when(flag.isin("N", "A"), F.array(result, start)).otherwise(F.array(start))).alias("entry")).select("*", "entry.*")
    extra = [F.min("month").alias("month"), F.min("day").alias("first_day"), *ed.career_sums(*career)]
    # of rows with equal values it makes no difference which are among the first ten: only their values are summed
    summaries = ed.summarise_lists(listed, ["race_id", "year", "list", "stage"], F.col("value"), [F.desc("value")], extra)
    return checkpointed(_rounded(summaries.withColumn("list", F.element_at(kinds, F.col("list")))))


def race_names(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    ending = F.when(key % 9 == 4, " Time Trial").when(key % 9 == 7, " Chrono").otherwise("")
    return table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        key.alias("race_id"),
        F.concat("s_name", ending).alias("base_name"),
        F.col("n_name").alias("race_country"),
        F.when(F.col("s_nationkey") % 2 == 0, "1").otherwise("2").alias("type_digit"),
    )


def category(type_digit: Column, entries: Column) -> Column:
    return F.concat(type_digit, F.lit("."), F.when(entries >= 88, "Pro").otherwise("1"))


def entries(spark: SparkSession, folder: str, summaries: DataFrame | None = None) -> DataFrame:
    """The races of each season: whatever has a startlist."""
    lists = list_summaries(spark, folder) if summaries is None else summaries
    seasons = lists.where("list = 'start'").select("race_id", "year", "month", "first_day", "rows")
    renamed = (F.col("year") >= 1999) & (F.col("race_id") % 13 == 5)
    return seasons.join(shuffled(race_names(spark, folder)), ["race_id"]).select(
        "race_id", "year", "month",
        F.concat("base_name", F.when(renamed, " Classic").otherwise("")).alias("race_name"),
        F.concat(
            F.when(F.col("type_digit") == "1", "One-day race, ").otherwise("Stage race, "), "race_country"
        ).alias("race_subtitle"),
        "race_country",
        F.date_format("first_day", "dd.MM").alias("date_label"),
        category(F.col("type_digit"), F.col("rows")).alias("category"),
    )


def edition_tables(spark: SparkSession, folder: str, no_results: Column | None = None, no_startlist: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Editions and what could not be built; the conditions name races whose pages are taken to be missing."""
    lists, keys = list_summaries(spark, folder), ["race_id", "year"]
    missing = {"gc": no_results, "start": no_startlist}
    kind = lambda name: lists.where((F.col("list") == name) & (F.lit(True) if missing.get(name) is None else ~missing[name]))
    stages = ed.summarise_stages(ed.result_measures(kind("stage"), [*keys, "stage"]), keys)
    return ed.assemble_editions(
        entries(spark, folder, lists), ed.result_measures(kind("gc"), keys), ed.startlist_measures(kind("start"), keys), stages
    )


def editions(spark: SparkSession, folder: str) -> DataFrame:
    return edition_tables(spark, folder)[0]


def planning(spark: SparkSession, folder: str, year: int = 2002) -> DataFrame:
    """Next season's calendar: most races return, some in another category, some out of scope."""
    key = F.col("race_id")
    tier = F.when(key % 5 == 0, "Pro").when(key % 5 == 1, "2").when(key % 5 == 2, "UWT").otherwise("1")
    return race_names(spark, folder).where(key % 6 != 5).select(
        "race_id", F.col("base_name").alias("race_name"), F.concat("type_digit", F.lit("."), tier).alias("category"),
        F.concat(F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((key % 12 + 1).cast("string"), 2, "0")).alias("date_label"),
        (key % 12 + 1).cast("int").alias("month"), F.lit(year).alias("year"),
    )


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as rider contributions of nation teams, and one riderless placeholder team per region."""
    orders = table(spark, folder, "orders").join(shuffled(table(spark, folder, "customer")), F.col("o_custkey") == F.col("c_custkey"))
    price, pending = F.col("o_totalprice"), F.col("o_orderstatus") == "P"
    counted = F.when(pending, F.lit(0.0)).otherwise(price)
    sanction = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"), F.lit(10.0)).otherwise(F.lit(0.0))
    totals = orders.groupBy("c_nationkey").agg(
        F.round(F.sum(counted), 2).alias("team_total_points"), F.sum(sanction).alias("sanction_points_total")
    )
    teams = totals.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_nationkey",
        F.lit("current").alias("scope"), F.lit("").alias("cycle_label"),
        (F.col("n_nationkey") + 1).alias("team_rank"), F.col("n_name").alias("team_name"),
        F.lower("n_name").alias("team_slug"), F.lit("PRT").alias("team_class"),
        (F.col("team_total_points") - F.col("n_nationkey") % 3).alias("ranking_total_points"),
        "team_total_points", "sanction_points_total",
        F.lit("").alias("ranking_url"), F.lit("").alias("source_url"), F.lit("2001-12-31").alias("scraped_at"),
    )
    # 25 nations, whatever the number of orders.
    rows = orders.join(F.broadcast(teams), ["c_nationkey"]).select(
        *[c for c in teams.columns if c != "c_nationkey"],
        F.year("o_orderdate").alias("season_year"),
        F.col("c_name").alias("rider_name"),
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("rider_slug"),
        counted.alias("points_counted"),
        F.when(pending, price).otherwise(F.lit(0.0)).alias("points_not_counted"),
        sanction.alias("sanction_points"),
        F.lit(False).alias("is_placeholder_team_row"),
    )
    zero = F.lit(0.0)
    empty = table(spark, folder, "region").select(
        F.lit("current").alias("scope"), F.lit("").alias("cycle_label"), (F.col("r_regionkey") + 100).alias("team_rank"),
        F.col("r_name").alias("team_name"), F.lower("r_name").alias("team_slug"), F.lit("PRT").alias("team_class"),
        zero.alias("ranking_total_points"), zero.alias("team_total_points"), zero.alias("sanction_points_total"),
        F.lit("").alias("ranking_url"), F.lit("").alias("source_url"), F.lit("2001-12-31").alias("scraped_at"),
        F.lit(None).cast("int").alias("season_year"), F.lit("").alias("rider_name"), F.lit("").alias("rider_slug"),
        zero.alias("points_counted"), zero.alias("points_not_counted"), zero.alias("sanction_points"),
        F.lit(True).alias("is_placeholder_team_row"),
    )
    return rows.unionByName(empty)


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Events as race intervals of users; errors have no end."""
    seconds = F.floor(F.col("value") * 60).cast("int")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("team_slug"), F.lit(2024).alias("planning_year"), F.col("event_id").alias("race_id"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("race_name"),
        F.col("ts").alias("start_date"), F.when(F.col("event_type") != "error", end).alias("end_date"),
    )


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a previous and a latest schedule snapshot with known edits."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    base = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("team_slug"), F.year("o_orderdate").alias("planning_year"), key.alias("race_id"),
        F.concat(F.lit("Order "), key.cast("string")).alias("race_name"), day.alias("day"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("scheduled").alias("status"),
    )
    rid = F.col("race_id")
    flipped = F.when(F.col("status") == "completed", "scheduled").otherwise("completed")
    previous = base.where(rid % 7 != 0).select(
        "team_slug", "planning_year", "race_id", "race_name", F.date_format("day", "dd.MM").alias("date_label"),
        F.lit("1.1").alias("category"), "status",
        F.when(rid % 23 != 0, "active").alias("team_calendar_status"), F.lit("before").alias("notes"),
    )
    latest = base.where(rid % 5 != 0).select(
        "team_slug", "planning_year", "race_id", "race_name",
        F.date_format(F.when(rid % 13 == 0, F.date_add("day", 1)).otherwise(F.col("day")), "dd.MM").alias("date_label"),
        F.when(rid % 17 == 0, "1.Pro").otherwise("1.1").alias("category"),
        F.when(rid % 11 == 0, flipped).otherwise(F.col("status")).alias("status"),
        F.when(rid % 19 == 0, "withdrawn").otherwise("active").alias("team_calendar_status"), F.lit("after").alias("notes"),
    )
    return previous, latest


# --- names: parts are planned races, line items are observed programme rows -----------------


def planned_races(spark: SparkSession, folder: str, *also: str) -> DataFrame:
    """Parts as the planning calendars of seven seasons; `also` names columns of the part to keep."""
    key = F.col("p_partkey")
    code = F.concat(F.lit("P"), key.cast("string"))
    name = (
        F.when(key % 5 == 0, F.concat("p_name", F.lit(" Race "), code))
        .when(key % 5 == 1, F.concat(F.lit("Grand Prix "), "p_name", F.lit(" "), code))
        .when(key % 5 == 2, F.concat(F.lit("Tour of "), "p_name", F.lit(" "), code, F.lit(" - "), "p_type"))
        .when(key % 5 == 3, F.concat(F.lit("Trofeo "), "p_type", F.lit(" "), "p_name"))
        .otherwise(F.concat(F.lit('Clásica "'), "p_name", F.lit('" '), code))
    )
    season = (F.lit(1995) + key % 7).cast("int")
    start = F.date_add(F.make_date(season, F.lit(1), F.lit(1)), (key * 7 % 330).cast("int"))
    days = (F.col("p_size") % 6).cast("int")
    label = F.when(days == 0, F.date_format(start, "dd.MM")).otherwise(
        F.concat(F.date_format(start, "dd.MM"), F.lit("-"), F.date_format(F.date_add(start, days), "dd.MM"))
    )
    # its file is small for the names and dates that are made of each row
    return table(spark, folder, "part").repartition("p_partkey").select(
        key.alias("race_id"), name.alias("race_name"), F.when(key % 2 == 0, "1.1").otherwise("2.1").alias("category"),
        label.alias("date_label"), F.month(start).alias("month"), season.alias("year"), *also,
    )


def race_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Sponsor names of every fourth part: for all teams, for one team, or for one season."""
    key = F.col("p_partkey")
    base = table(spark, folder, "part").where(key % 4 == 0)
    name = F.concat(F.lit("Sponsor "), key.cast("string"), F.lit(" Open"))
    open_to_all = base.select(
        F.lit("").alias("team_slug"), F.lit(None).cast("int").alias("planning_year"), name.alias("source_race_name"),
        F.lit("").alias("canonical_race_name"), key.alias("race_id"), (key * 2 + 1).alias("alias_order"),
    )
    one_team = base.where(key % 8 == 0).select(
        F.concat(F.lit("team-"), (key % 20).cast("string")).alias("team_slug"), (F.lit(1995) + key % 7).cast("int").alias("planning_year"),
        name.alias("source_race_name"), F.concat(F.lit("Open of "), "p_name").alias("canonical_race_name"),
        (key + 1).alias("race_id"), (key * 2).alias("alias_order"),
    )
    return open_to_all.unionByName(one_team)


def programme(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as observed programme rows: the part's race under a changed name, on a day near it."""
    parts = prepare_planning(planned_races(spark, folder, "p_name", "p_type")).select("race_id", "race_name", "planning_year", "start_date", "p_name", "p_type")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("race_id"), "l_suppkey", "l_returnflag")
    joined = rows.join(shuffled(parts), ["race_id"])
    number, code = F.col("l_linenumber"), F.concat(F.lit("P"), F.col("race_id").cast("string"))
    name = (
        F.when(number % 6 == 0, F.concat("race_name", F.lit(" ME")))
        .when(number % 6 == 1, F.concat("race_name", F.lit(" / Étape")))
        .when(number % 6 == 2, F.concat(F.upper("p_name"), F.lit(" "), code))
        .when(number % 6 == 3, F.concat(F.lit("Grote "), "p_name"))
        .when(number % 6 == 4, F.concat(F.lit("Sponsor "), F.col("race_id").cast("string"), F.lit(" Open")))
        .otherwise(F.concat(code, F.lit(" & "), "p_type"))
    )
    day = F.date_add("start_date", (number % 4).cast("int"))
    return joined.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("team-"), (F.col("l_suppkey") % 20).cast("string")).alias("team_slug"),
        F.concat(F.lit("Team "), (F.col("l_suppkey") % 20).cast("string")).alias("team_name"),
        "planning_year", F.lit("team_program_live").alias("source"), name.alias("source_race_name"),
        F.when(F.col("l_returnflag") != "R", F.date_format(day, "yyyy-MM-dd")).alias("observed_date"),
    )


# --- expected values: nations race the suppliers they bought from in 2001 -------------------


def season_points(spark: SparkSession, folder: str) -> DataFrame:
    """What each nation bought from each supplier in the planning year."""
    day = F.col("l_shipdate")
    bound = lambda year: F.lit(f"{year}-01-01").cast("timestamp_ntz")
    # A range on the column itself reaches the parquet scan; year(l_shipdate) would not.
    sold = table(spark, folder, "lineitem").where((day >= bound(PLANNING_YEAR)) & (day < bound(PLANNING_YEAR + 1)))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    # the lines of one season meet their orders first, so only orders with such a line go on to their customers
    ordered = sold.join(shuffled(orders), F.col("l_orderkey") == F.col("o_orderkey"))
    return ordered.join(shuffled(table(spark, folder, "customer").select("c_custkey", "c_nationkey")), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.col("l_suppkey").alias("supplier")).agg(
        F.sum("l_extendedprice").alias("points"), F.min(F.col("l_shipdate").cast("date")).alias("first_day"), F.count(F.lit(1)).alias("riders")
    )


def _team(nation: Column) -> Column:
    return F.concat(F.lit("nation-"), nation.cast("string"))


def team_calendars(spark: SparkSession, folder: str, season: DataFrame | None = None) -> DataFrame:
    """The season of every nation; one supplier in ten is a new top-level race without history.

    `season` are the `season_points` where the caller has them already.
    """
    key = F.col("supplier")
    fresh = key % 10 == 3
    races = (season_points(spark, folder) if season is None else season).join(shuffled(race_names(spark, folder)), key == F.col("race_id")).select(
        _team(F.col("c_nationkey")).alias("team_slug"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("team_name"),
        F.lit(PLANNING_YEAR).alias("planning_year"),
        F.when(key % 3 == 0, "team_program_live").when(key % 3 == 1, "observed_startlist").otherwise("calendar_seed").alias("source"),
        F.when(fresh, key + 1000000000).otherwise(key).alias("race_id"),
        F.col("base_name").alias("race_name"),
        F.concat(
            "type_digit", F.lit("."), F.when(fresh, "UWT").when(key % 4 == 0, "Pro").when(key % 7 == 6, "2").otherwise("1")
        ).alias("category"),
        F.date_format("first_day", "dd.MM").alias("date_label"),
        F.month("first_day").alias("month"),
        F.col("first_day").alias("start_date"),
        F.date_add("first_day", (key % 5).cast("int")).alias("end_date"),
        key,
    )
    status = F.when(key % 17 == 2, "cancelled").otherwise(status_as_of(F.col("end_date"), AS_OF))
    full = races.withColumns(
        {
            "status": status,
            "team_calendar_status": F.lit("active"),
            "pcs_race_slug": F.concat(F.lit("race-"), key.cast("string")),
            "notes": F.when(key % 2 == 0, "matched_via=alias").otherwise(""),
        }
    ).drop("supplier")
    return with_overlap_groups(full)


def actual_points(spark: SparkSession, folder: str, season: DataFrame | None = None) -> DataFrame:
    """Known results: what was bought, unknown for every fourth supplier. `season` as for `team_calendars`."""
    key = F.col("supplier")
    return (season_points(spark, folder) if season is None else season).where(key % 4 != 1).select(
        _team(F.col("c_nationkey")).alias("team_slug"), F.lit(PLANNING_YEAR).alias("planning_year"),
        F.when(key % 10 == 3, key + 1000000000).otherwise(key).alias("race_id"), F.round("points", 2).alias("actual_points"),
    )


def raw_weights(key: Column) -> list[Column]:
    return [
        1 + key * 3 % 7, 1 + key * 5 % 7, 1 + key * 2 % 5, 1 + key % 2, 1 + key * 4 % 6, 1 + key * 6 % 9,
    ]


def team_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """A profile per nation with weights that follow from its key."""
    key = F.col("n_nationkey")
    raw = F.create_map(*[x for axis, w in zip(PROFILE_AXES, raw_weights(key)) for x in (F.lit(axis), w.cast("double"))])
    profiles = table(spark, folder, "nation").select(
        _team(key).alias("team_slug"), F.lit(PLANNING_YEAR).alias("planning_year"),
        F.concat(F.lit("Nation "), key.cast("string")).alias("team_name"),
        normalised_map(raw, PROFILE_AXES).alias("strength_weights"),
        F.when(key % 4 == 0, F.lit(0.65)).otherwise(F.lit(0.70)).alias("team_fit_floor"),
        F.when(key % 4 == 0, F.lit(0.35)).otherwise(F.lit(0.30)).alias("team_fit_range"),
        map_literal(EXECUTION_RULES).alias("execution_rules"), map_literal(PARTICIPATION_RULES).alias("participation_rules"),
        F.lit("").alias("archetype_label"), F.lit("").alias("archetype_description"),
        F.lit("medium").alias("profile_confidence"), F.lit("v1").alias("profile_version"),
        F.array(F.lit("Derived from the nation key.")).alias("profile_rationale"),
    )
    return with_inferred_archetype(profiles, "archetype_key")
