"""Reading the model's tables from files, with explicit schemas, and writing them back."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from echelon import schemas
from echelon.constants import FLAG_FALSE, FLAG_TRUE, PLANNING_CATEGORIES, PROFILE_AXES
from echelon.functions.columns import blank, first_filled, normalised_map, text, with_defaults
from echelon.functions.text import race_slug, stable_slug
from echelon.operators.editions import with_stage_columns
from echelon.operators.matching import prepare_aliases
from echelon.operators.profiles import check_presets
from echelon.operators.team_calendar import prepare_planning

TEAM_KEYS = ["team_slug", "planning_year"]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _csv_by_name(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV columns picked by header name and cast to the schema; absent columns stay out."""
    raw = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    wanted = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    return raw.select(*[F.col(f"`{c}`").try_cast(wanted[c]).alias(c) if c in wanted else F.col(f"`{c}`") for c in raw.columns])


def read_table(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A table from parquet (default) or `*.csv`; a path that does not exist reads as empty unless it is required."""
    try:
        if path.rstrip("/").endswith(".csv"):
            return _csv_by_name(spark, path, schema)
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if required:
            raise FileNotFoundError(f"no table at {path}") from error
        return empty(spark, schema)


def read_editions(
    spark: SparkSession, path: str, years: Iterable[int] | None = None, categories: Iterable[str] | None = None
) -> DataFrame:
    """Edition table with the stage columns filled in, filtered in the scan."""
    editions = with_stage_columns(read_table(spark, path, schemas.EDITION))
    if years:
        editions = editions.where(F.col("year").isin(*years))
    if categories:
        editions = editions.where(F.col("category").isin(*categories))
    return editions


def read_planning(
    spark: SparkSession, landed: str | None, snapshot: str | None, categories: Sequence[str] = PLANNING_CATEGORIES, months: Sequence[int] = tuple(range(1, 13))
) -> DataFrame:
    """Planning calendar: the landed one, else the snapshot, else empty; `calendar_source` says which."""
    for path, source in ((landed, "live"), (snapshot, "snapshot")):
        if path is None:
            continue
        rows = read_table(spark, path, schemas.PLANNING).where(F.col("category").isin(*categories) & F.col("month").isin(*months))
        if not rows.isEmpty():
            return rows.select("race_id", "race_name", "category", "date_label", "month", "year").withColumn("calendar_source", F.lit(source))
    return empty(spark, schemas.PLANNING).withColumn("calendar_source", F.lit("unavailable"))


def read_prepared_planning(spark: SparkSession, path: str, planning_year: int | None = None) -> DataFrame:
    """Planning calendar with comparable names and parsed dates."""
    rows = read_table(spark, path, schemas.PLANNING)
    return prepare_planning(rows if planning_year is None else rows.where(F.col("year") == planning_year))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias table; `alias_order` is the order of preference, and without it the smallest race id is preferred."""
    return prepare_aliases(read_table(spark, path, schemas.ALIAS))


def read_contributions(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    rows = with_defaults(read_table(spark, path, schemas.CONTRIBUTION), {"is_placeholder_team_row": False})
    rows = rows.withColumn("is_placeholder_team_row", F.coalesce("is_placeholder_team_row", F.lit(False)))
    return rows if scope is None else rows.where(F.col("scope") == scope)


def read_programme(spark: SparkSession, path: str) -> DataFrame:
    """Observed programme rows; a missing link is empty, a missing race slug comes from the link."""
    rows = read_table(spark, path, schemas.PROGRAMME)
    if "source_race_name" not in rows.columns and "race_name" in rows.columns:
        rows = rows.withColumnRenamed("race_name", "source_race_name")
    rows = with_defaults(rows, {"source_url": ""})
    if "pcs_race_slug" not in rows.columns:
        rows = rows.withColumn("pcs_race_slug", race_slug(F.col("source_url")))
    if "observed_date" not in rows.columns:
        rows = rows.withColumn("observed_date", F.col("date_label") if "date_label" in rows.columns else F.lit(""))
    return rows


def manifest_errors() -> Column:
    """Everything wrong with a manifest row."""
    year = F.trim(text(F.col("planning_year")))
    flag = F.lower(F.trim(text(F.col("enabled"))))
    say = lambda condition, message: F.when(condition, message)
    return F.array_compact(
        F.array(
            say(year == "", F.lit("missing planning_year")),
            say((year != "") & year.try_cast("int").isNull(), F.concat(F.lit("invalid planning_year: "), year)),
            *[say(blank(F.col(c)), F.lit(f"missing {c}")) for c in ("team_slug", "pcs_team_slug", "team_name")],
            say(~flag.isin(*FLAG_TRUE, *FLAG_FALSE), F.concat(F.lit("unsupported enabled value: "), flag)),
        )
    )


def check_manifest(rows: DataFrame) -> DataFrame:
    """Manifest rows, cleaned, with an `errors` column."""
    checked = with_defaults(rows, {"profile_path": "", "enabled": "", "notes": ""}).withColumn("errors", manifest_errors())
    year = F.trim(text(F.col("planning_year"))).try_cast("int")
    return checked.select(
        stable_slug(F.col("team_slug"), year).alias("team_slug"), F.trim(text(F.col("pcs_team_slug"))).alias("pcs_team_slug"),
        F.trim(text(F.col("team_name"))).alias("team_name"), year.alias("planning_year"), F.trim(text(F.col("profile_path"))).alias("profile_path"),
        F.lower(F.trim(text(F.col("enabled")))).isin(*FLAG_TRUE).alias("enabled"), F.trim(text(F.col("notes"))).alias("notes"), "errors",
    )


def read_manifest(spark: SparkSession, path: str, enabled_only: bool = False, team_slug: str | None = None) -> DataFrame:
    """Tracked teams. A missing file and any bad row fail the read, with the first problems named."""
    rows = read_table(spark, path, schemas.MANIFEST, required=True)
    missing = [c for c in ("team_slug", "pcs_team_slug", "team_name", "planning_year") if c not in rows.columns]
    if missing:
        raise ValueError(f"Tracked-team manifest missing required columns: {', '.join(missing)}")
    checked = check_manifest(rows)
    bad = checked.where(F.size("errors") > 0).limit(5).collect()
    if bad:
        raise ValueError("Tracked-team manifest has bad rows: " + "; ".join(f"{r.team_slug or '?'}: {', '.join(r.errors)}" for r in bad))
    teams = checked.drop("errors")
    if enabled_only:
        teams = teams.where("enabled")
    if team_slug is not None:
        teams = teams.where(F.col("team_slug") == stable_slug(F.lit(team_slug), F.col("planning_year")))
    return teams


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile documents (one JSON object per file or line) as rows."""
    return spark.read.schema(schemas.PROFILE).option("multiLine", True).json(path)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one value `d`; a missing file or a document of another shape fails the read."""
    try:
        found = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).where("d IS NOT NULL")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no document at {path}") from error
    if found.isEmpty():
        raise ValueError(f"{path} holds no document of the expected shape")
    return found


def read_archetypes(spark: SparkSession, path: str) -> DataFrame:
    """An archetype document (key -> label, description, colour, weights) as catalog rows, weights normalised."""
    rows = _document(spark, path, schemas.ARCHETYPE_DOCUMENT).select(F.explode("d").alias("archetype_key", "a")).select("archetype_key", "a.*")
    bad = [r.archetype_key for r in rows.where(blank(F.col("label")) | blank(F.col("description"))).collect()]  # a handful of archetypes
    if bad or rows.isEmpty():
        raise ValueError(f"archetypes need a label and a description: {', '.join(sorted(bad)) or 'the document is empty'}")
    prior = F.when(F.col("strength_weight_prior").isNotNull(), normalised_map(F.col("strength_weight_prior"), PROFILE_AXES))
    return rows.select("archetype_key", F.trim("label").alias("label"), F.trim("description").alias("description"), text(F.col("color")).alias("color"), prior.alias("strength_weight_prior"))


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """A scenario preset document as rows (preset_version, key, label, description, profile_overrides) in document order."""
    document = _document(spark, path, schemas.PRESET_DOCUMENT).select("d.*")
    head = document.first()  # one small document
    problems = check_presets(head.preset_version, head.roster_scenario_scope, [p.asDict() for p in head.presets or []])
    if problems:
        raise ValueError("; ".join(problems))
    return document.select("preset_version", F.posexplode("presets").alias("preset_order", "p")).select("preset_version", "preset_order", "p.*")


def find_preset(presets: DataFrame, key: str) -> DataFrame:
    found = presets.where(F.col("key") == key)
    if found.isEmpty():
        raise ValueError(f"Unknown scenario preset `{key}`.")
    return found


def team_names(teams: DataFrame, contributions: DataFrame) -> DataFrame:
    """Display name and reference total per team from the contribution table; the slug where it is unknown.

    Both come from the same row, the first by scope, cycle, season and place in the counted list.
    """
    first = F.struct("scope", "cycle_label", "season_year", "team_rank_within_counted_list", "rider_slug")
    known = contributions.groupBy(F.col("team_slug").alias("pcs_team_slug")).agg(
        F.min_by(F.struct(F.col("team_name").alias("_name"), F.col("team_total_points").alias("reference_total_points")), first).alias("_known")
    )
    joined = teams.join(known, ["pcs_team_slug"], "left").select(*teams.columns, "_known.*")
    return joined.withColumn("team_name", first_filled(F.col("_name"), F.col("team_slug"))).drop("_name")


# --- writing ---------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that `df` holds (dynamic overwrite), so single teams can be refreshed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def typed(df: DataFrame, schema: str) -> DataFrame:
    """Columns that the schema names, in its types, so that the readers find what they expect."""
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in df.columns if c in kinds})


def write_editions(editions: DataFrame, path: str) -> None:
    write_table(typed(editions, schemas.EDITION), path, ["year"])


def write_contributions(contributions: DataFrame, path: str) -> None:
    write_table(typed(contributions, schemas.CONTRIBUTION), path, ["scope"])


def write_season(tables: dict[str, DataFrame], root: str) -> None:
    """One table per artifact under `root`, partitioned by season and, where it has teams, by team."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", [c for c in ("planning_year", "team_slug") if c in df.columns])


def read_season(spark: SparkSession, root: str, name: str, schema: str, team_slug: str | None = None, planning_year: int | None = None) -> DataFrame:
    """An artifact table; team and season become partition filters."""
    rows = read_table(spark, f"{root}/{name}", schema)
    if team_slug is not None:
        rows = rows.where(F.col("team_slug") == team_slug)
    return rows if planning_year is None else rows.where(F.col("planning_year") == planning_year)


def season_catalog(summary: DataFrame, ev: DataFrame) -> DataFrame:
    """Team-seasons that have both a summary and race rows, with a display label, newest first."""
    named = ev.groupBy(*TEAM_KEYS).agg(F.max(F.trim("team_name")).alias("team_name"))
    plain = F.initcap(F.replace("team_slug", F.lit("-"), F.lit(" ")))
    listed = summary.where(~blank(F.col("team_slug")) & F.col("planning_year").isNotNull()).select(*TEAM_KEYS).distinct().join(named, TEAM_KEYS)
    labelled = listed.withColumn("team_name", first_filled(F.col("team_name"), plain))
    return labelled.withColumn("label", F.concat("team_name", F.lit(" ("), F.col("planning_year").cast("string"), F.lit(")"))).orderBy(
        F.desc("planning_year"), "team_name"
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export of a result view; dates and timestamps as ISO text, quotes doubled, as the readers take them."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


_SOURCE_WORDS = ("url", "pcs")
_SOURCE_VALUE = r"^https?://|procyclingstats|(^|\s)pcs(\s|$)"


def _named(name: str) -> bool:
    return any(word in name.lower() for word in _SOURCE_WORDS)


def _names_source(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).rlike(_SOURCE_VALUE), F.lit(False))


def _pruned(kind: T.DataType, value: Column) -> Column:
    """A value without what names a source: struct fields and map keys by name, texts in them and array elements by value."""
    if isinstance(kind, T.StringType):
        return F.when(~_names_source(value), value)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda one: _pruned(kind.elementType, one))
        return F.filter(inner, lambda one: one.isNotNull()) if isinstance(kind.elementType, T.StringType) else inner
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda key, _: ~F.lower(key.cast("string")).rlike("|".join(_SOURCE_WORDS)))
        if isinstance(kind.valueType, T.StringType):
            return F.map_filter(kept, lambda _, one: one.isNull() | ~_names_source(one))
        return F.transform_values(kept, lambda _, one: _pruned(kind.valueType, one))
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if not _named(f.name)]
        if not fields:
            return F.lit(None).cast("string")
        return F.when(value.isNotNull(), F.struct(*[_pruned(f.dataType, value[f.name]).alias(f.name) for f in fields]))
    return value


def without_sources(df: DataFrame) -> DataFrame:
    """Drop what names a data source: columns by their name or, for texts, by any of their values (one pass).

    In nested columns only the offending field, key or element goes; a nested text field keeps its place as null.
    """
    kept = [f for f in df.schema.fields if not _named(f.name)]
    texts = [f.name for f in kept if isinstance(f.dataType, T.StringType)]
    found = df.agg(*[F.max(_names_source(F.col(f"`{name}`"))).alias(name) for name in texts]).first() if texts else {}
    kept = [f for f in kept if not (f.name in texts and found[f.name])]
    plain = (T.StringType,)
    return df.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else _pruned(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in kept])
