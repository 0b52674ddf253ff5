"""Season tables published as snapshots: all tables of a version become visible at once, or none does.

A version writes its rows into folders of its own, then a single manifest file that names, for every table and team-season,
the folder that holds its rows. The manifest is the last thing written and its file appears by one rename, so readers see
the version before or the version after, whatever happens to a build. Team-seasons that a version does not touch keep
pointing to the folder they are in; nothing of them is read or written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from echelon import schemas
from echelon.sources.tables import TEAM_KEYS, empty, season_catalog

MANIFEST = "artifact string, team_slug string, planning_year int, folder string, rows bigint, version bigint"
#: A row that every manifest has, so that a version without any table is one, too.
_MARK = "_version"
_LENIENT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def _read(spark: SparkSession, path: str, schema: str | T.StructType, options: Mapping[str, str] | None = None) -> DataFrame | None:
    try:
        return spark.read.options(**(options or {})).schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Where the rows of each table and team-season are, in the newest version or a given one; empty before the first."""
    found = _read(spark, f"{root}/manifest", MANIFEST)
    if found is None:
        return empty(spark, MANIFEST)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == F.lit(version))


def current_version(spark: SparkSession, root: str) -> int:
    """The newest published version, 0 before the first."""
    return manifest(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("planning_year", "team_slug") if c in df.columns]


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], replaced: DataFrame | None = None, tracked: DataFrame | None = None) -> int:
    """Write `tables` as the next version and return its number.

    Rows of team-seasons in `replaced` (all, if not given) come from `tables` alone; those of other tracked team-seasons
    (all others, if `tracked` is not given) stay as they were. A table without teams is replaced as a whole. Two writers
    of the same version can't both succeed: the second finds its manifest there.
    """
    before = manifest(spark, root)
    version = current_version(spark, root) + 1
    folder = f"v{version}-{uuid.uuid4().hex[:12]}"
    listed = []
    for name, df in tables.items():
        path, keys = f"{root}/data/{folder}/{name}", _keys(df)
        # the rows of a team-season meet, so that it has few files; adaptive execution splits one that holds very many
        (df.hint("rebalance", *keys) if keys else df).write.partitionBy(*keys).parquet(path)
        # counted from what was written
        written = _read(spark, path, df.schema)
        counted = (empty(spark, "x int") if written is None else written).groupBy(*(keys if written is not None else [])).agg(F.count(F.lit(1)).alias("rows"))
        columns = [F.col(c) if c in keys and written is not None else F.lit(None).alias(c) for c in TEAM_KEYS]
        listed.append(counted.select(F.lit(name).alias("artifact"), *columns, F.lit(folder).alias("folder"), "rows").where("rows > 0"))
    kept = before.where(F.col("artifact") != _MARK).drop("version")
    whole = [name for name, df in tables.items() if "team_slug" not in df.columns]
    kept = kept.where(~F.col("artifact").isin(whole)) if whole else kept
    if replaced is None:
        kept = kept.where(~F.col("artifact").isin(list(tables)))
    else:
        kept = kept.join(replaced.select(*TEAM_KEYS), TEAM_KEYS, "left_anti")
    if tracked is not None:
        held = kept.where("team_slug IS NOT NULL").join(tracked.select(*TEAM_KEYS), TEAM_KEYS, "left_semi")
        kept = held.unionByName(kept.where("team_slug IS NULL"))
    mark = spark.range(1).select(F.lit(_MARK).alias("artifact"), F.lit(None).cast("string").alias("team_slug"), F.lit(None).cast("int").alias("planning_year"), F.lit(folder).alias("folder"), F.lit(1).cast("long").alias("rows"))
    rows = reduce(DataFrame.unionByName, [mark, kept, *[one.select(mark.columns) for one in listed]])
    # one file: it is there or not
    rows.repartition(1).write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")
    return version


def read_artifact(
    spark: SparkSession, root: str, name: str, schema: str | T.StructType, team_slug: str | None = None, planning_year: int | None = None,
    version: int | None = None, lenient: bool = False,
) -> DataFrame:
    """A published table; team and season become partition filters. With `lenient`, files that can't be read have no rows."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    places = manifest(spark, root, version).where(F.col("artifact") == name)
    wanted = {"team_slug": team_slug, "planning_year": planning_year}
    for column, value in wanted.items():
        if value is not None:
            places = places.where(F.col(column) == value)
    frames = []
    for (folder,) in places.select("folder").distinct().collect():  # as many as versions that still hold rows
        rows = _read(spark, f"{root}/data/{folder}/{name}", kind, _LENIENT if lenient else None)
        if rows is None and not lenient:
            raise FileNotFoundError(f"no folder {folder} of {name}")
        if rows is None:
            continue
        for column, value in wanted.items():
            if value is not None:
                rows = rows.where(F.col(column) == value)
        keys = _keys(rows)
        if "team_slug" in keys:
            here = places.where(F.col("folder") == folder).select(*keys)
            rows = rows.join(here, keys, "left_semi")
        frames.append(rows)
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], kind)


def published_catalog(spark: SparkSession, root: str, summary: str = schemas.EV_SUMMARY, values: str = schemas.EV) -> DataFrame:
    """Team-seasons of the newest version whose summary and race rows are all readable, as `season_catalog` lists them.

    A season with a missing or unreadable file is skipped, also where other files of it can be read.
    """
    places = manifest(spark, root)

    def whole(name: str, schema: str) -> DataFrame:
        rows = read_artifact(spark, root, name, schema, lenient=True)
        found = rows.groupBy(*TEAM_KEYS).agg(F.count(F.lit(1)).alias("found"))
        wanted = places.where(F.col("artifact") == name).select(*TEAM_KEYS, "rows")
        complete = found.join(wanted, TEAM_KEYS).where("found = rows").select(*TEAM_KEYS)
        return rows.join(complete, TEAM_KEYS, "left_semi")

    return season_catalog(whole("team_ev_summary", summary), whole("team_calendar_ev", values))
