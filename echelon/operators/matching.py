"""Match observed race names to the planning calendar: alias, exact variant, token overlap.

Everything works on distinct (name, date) combinations, never on raw programme rows or once per team, and
every step is an equi-join. The token step never lists the pairs that share common words: races
are counted per set of shared words, so the rows per observed name depend on its own words only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echelon.functions.columns import first_filled, text
from echelon.functions.dates import as_date
from echelon.functions.text import name_variants, normalise_name, stable_slug, tokens_of
from echelon.operators.spread import checkpointed, let_go, shuffled, skew_join

_SEASON = "planning_year"
#: Names of at most so many words are matched through the sets of words that they share.
MOST_WORDS = 8


def prepare_aliases(aliases: DataFrame) -> DataFrame:
    """Alias rows with comparable name and stable slug; `alias_order` is the order of preference.

    Without it all aliases are of the same order, and the smallest race id, then name, is preferred.
    """
    have = set(aliases.columns)
    slug = text(F.col("team_slug")) if "team_slug" in have else F.lit("")
    year = F.col(_SEASON).try_cast("int") if _SEASON in have else F.lit(None).cast("int")
    order = F.col("alias_order") if "alias_order" in have else F.lit(0)
    canonical = text(F.col("canonical_race_name")) if "canonical_race_name" in have else F.lit("")
    return aliases.select(
        stable_slug(slug, year).alias("team_slug"),
        year.alias(_SEASON),
        "source_race_name",
        canonical.alias("canonical_race_name"),
        F.col("race_id").try_cast("long").alias("race_id"),
        order.alias("alias_order"),
        normalise_name(F.col("source_race_name")).alias("normalized_source_race_name"),
    )


def _spellings(names: DataFrame, with_variants: bool) -> DataFrame:
    """Each spelling once with its `normalized_name`, and the `variants` to try if asked for."""
    source = F.col("source_race_name")
    normal = {"normalized_name": normalise_name(source), **({"variants": name_variants(source)} if with_variants else {})}
    # written, so that no later step moves the spelling back in front of `distinct`
    return checkpointed(checkpointed(names.select("source_race_name").distinct()).withColumns(normal))


def spelled(names: DataFrame, with_variants: bool = False) -> DataFrame:
    """The rows with `normalized_name`, and the `variants` to try if asked for.

    Each spelling is normalised once, however many teams and dates it comes with; the result is written, as several matchers read it.
    """
    names = checkpointed(names)
    return checkpointed(names.join(shuffled(_spellings(names, with_variants)), "source_race_name"))


def alias_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The preferred alias per (team, season, normalised name).

    An alias may leave team or season open. The four ways to be in scope become four exact
    keys, so a name with aliases for many teams is never crossed with all of them.
    """
    preferred = aliases.groupBy(
        F.col("normalized_source_race_name").alias("normalized_name"),
        F.col("team_slug").alias("_team"),
        F.coalesce(_SEASON, F.lit(-1)).cast("long").alias("_season"),
    ).agg(F.min(F.struct("alias_order", "race_id", "canonical_race_name")).alias("alias"))
    season = F.col(_SEASON).cast("long")
    scopes = F.array(
        *[
            F.struct(team.alias("team"), year.alias("season"))
            for team in (F.col("team_slug"), F.lit(""))
            for year in (season, F.lit(-1).cast("long"))
        ]
    )
    # only names that some alias has are looked up in all scopes
    keyed = names.select("team_slug", _SEASON, "normalized_name").join(shuffled(preferred.select("normalized_name").distinct()), "normalized_name", "left_semi").distinct()
    keyed = keyed.withColumn("_scope", F.explode(F.array_distinct(scopes)))
    keyed = keyed.select("team_slug", _SEASON, "normalized_name", F.col("_scope.team").alias("_team"), F.col("_scope.season").alias("_season"))
    found = keyed.join(shuffled(preferred), ["normalized_name", "_team", "_season"])
    return (
        found.groupBy("team_slug", _SEASON, "normalized_name")
        .agg(F.min("alias").alias("alias"))
        .select(
            "team_slug", _SEASON, "normalized_name",
            F.col("alias.race_id").alias("alias_race_id"),
            F.col("alias.canonical_race_name").alias("alias_name"),
            F.lit(True).alias("alias_found"),
        )
    )


def variant_matches(names: DataFrame, planning: DataFrame) -> DataFrame:
    """Per (season, source name): the race of the first variant that names exactly one race."""
    single = (
        planning.groupBy(_SEASON, F.col("normalized_race_name").alias("_variant"))
        .agg(F.count(F.lit(1)).alias("_races"), F.min(F.struct("race_id", "race_name")).alias("race"))
        .where("_races = 1")
    )
    if "variants" not in names.columns:
        names = names.withColumn("variants", name_variants(F.col("source_race_name")))
    tried = names.select(_SEASON, "source_race_name", "variants").dropDuplicates([_SEASON, "source_race_name"])
    tried = tried.select(_SEASON, "source_race_name", F.posexplode("variants").alias("_place", "_variant"))
    return (
        tried.join(shuffled(single), [_SEASON, "_variant"])
        .groupBy(_SEASON, "source_race_name")
        .agg(F.min_by("race", "_place").alias("race"))
        .select(
            _SEASON, "source_race_name",
            F.col("race.race_id").alias("variant_race_id"),
            F.col("race.race_name").alias("variant_name"),
        )
    )


def _rarer_words(sets: DataFrame, id: str, frequency: DataFrame, skipped: int) -> DataFrame:
    """(season, id, word) for all but the `skipped` most frequent words of each set.

    Two sets that share more than `skipped` words share at least one of these: leaving out that
    many per set, in one common order, cannot hide all of them.
    """
    words = sets.select(_SEASON, id, F.explode("words").alias("word")).join(shuffled(frequency), [_SEASON, "word"])
    ranked = words.groupBy(_SEASON, id).agg(F.array_sort(F.collect_list(F.struct("frequency", "word"))).alias("ranked"))
    kept = F.slice("ranked", F.lit(1), F.greatest(F.size("ranked") - skipped, F.lit(0)))
    return ranked.select(_SEASON, id, F.explode(kept).alias("r")).select(_SEASON, id, F.col("r.word").alias("word"))


def _prefix_pairs(seen: DataFrame, listed: DataFrame) -> DataFrame:
    """(seen_id, listed_id) of names that begin with a listed name.

    All words of the listed name but the last are the first words of the other. So each name is joined by its word
    prefixes with the lengths that listed names with these first words have, then cut to those lengths only.
    """
    words = F.split("name", " ")
    first = lambda count: F.array_join(F.slice(words, F.lit(1), count), " ")
    lengths = listed.select(_SEASON, first(F.size(words) - 1).alias("head"), F.length("name").alias("length")).groupBy(_SEASON, "head").agg(
        F.collect_set("length").alias("lengths")  # names are short, so there are few lengths
    )
    heads = seen.select(_SEASON, "seen_id", "name", F.explode(F.transform(F.sequence(F.lit(0), F.size(words) - 1), first)).alias("head"))
    cut = heads.join(shuffled(lengths), [_SEASON, "head"]).withColumn("length", F.explode("lengths")).where(F.col("length") <= F.length("name"))
    cut = cut.select(_SEASON, "seen_id", F.substring(F.col("name"), F.lit(1), F.col("length")).alias("name"))
    return cut.join(shuffled(listed.select(_SEASON, "name", "listed_id")), [_SEASON, "name"]).select("seen_id", "listed_id")


def _word_sets(words: Column, least: int) -> Column:
    """Every set of at least `least` of some sorted words, as structs of its size and its words."""
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("shared_words")))
    with_word = lambda word: lambda one: F.struct((one["n"] + 1).alias("n"), F.concat(one["shared_words"], word, F.lit(" ")).alias("shared_words"))
    return F.filter(F.aggregate(words, none, lambda sets, word: F.concat(sets, F.transform(sets, with_word(word)))), lambda one: one["n"] >= least)


def _sets_of_names(words: Column, long: Column, least: int) -> Column:
    """`_word_sets` of a short name; a long one has sets of one word only."""
    single = lambda word: F.struct(F.lit(1).alias("n"), F.concat(word, F.lit(" ")).alias("shared_words"))
    singles = F.filter(F.transform(words, single), lambda one: one["n"] >= least)
    return F.when(long, singles).otherwise(_word_sets(words, least))


def _largest_sets(wanted: DataFrame, counted: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """Per `id`: the size n of its largest sets that occur in `counted`, and the races that have one of them.

    `counted` has one row per set and is written, so nothing is listed per race, however many races share it.
    """
    met = wanted.join(shuffled(counted), [*keys, "n", "shared_words"], "inner").select(id, "n", "races", "race")
    # an `id` has few sets: they meet once, for the sums per size and for the largest size
    return met.repartition(id).groupBy(id, "n").agg(F.sum("races").alias("races"), F.min("race").alias("race")).groupBy(id).agg(
        F.max_by(F.struct("n", "races", "race"), "n").alias("largest")
    ).select(id, F.col("largest.n").alias("shared"), F.col("largest.races").alias("races"), F.col("largest.race").alias("race"))


def overlap_matches(names: DataFrame, planning: DataFrame) -> DataFrame:
    """Best race by shared words, date and prefix, when it is good enough and beats every other.

    Score: (shared words + date bonus + prefix bonus, shared words, date bonus); the bonus is 3 on
    a race day and 1 when the observed name starts with the race name. The first part must reach 3
    and the score be strictly above the runner-up's.

    Races are counted per set of words that names share, over the season and per race day. A race that shares
    the most words, n, with an observed name has exactly one of the name's sets of n words, so the sums of their counts say
    whether the best race is the only one. Sets of fewer words also hold races that score higher, but then those decide.
    Only pairs with a prefix, and pairs with a name of more than MOST_WORDS words, are listed. A race goes through all of it as the
    number of its candidate: only the race of a count of one is asked for in the end.

    Each way to score is written on its own: the driver holds the stages, tasks and metrics of a whole plan at once.
    """
    observation = [_SEASON, "normalized_name", "observed_date"]
    candidate = ["normalized_race_name", "start_date", "end_date"]
    # Races with the same name and dates always tie, so they are one candidate with a count.
    candidates = planning.groupBy(_SEASON, *candidate).agg(
        F.count(F.lit(1)).alias("races"), F.min(F.struct("race_id", "race_name")).alias("race")
    )
    day = as_date(F.when(F.col("observed_date") != "", F.col("observed_date")))
    observed = names.select(*observation).distinct().withColumn("day", day)

    def numbered(rows: DataFrame, name: str, id: str) -> DataFrame:
        """Distinct (season, name) with their words and a number; written, so the numbers stay."""
        distinct = rows.select(_SEASON, F.col(name).alias("name")).distinct()
        distinct = distinct.withColumn("words", F.array_sort(F.array_distinct(tokens_of(F.col("name"))))).withColumn("long", F.size("words") > MOST_WORDS)
        # numbered first: Spark would else look for the words in front of `distinct`, and in every name that is joined later
        return checkpointed(distinct.withColumn(id, F.monotonically_increasing_id()).where(F.size("words") > 0))

    seen, listed = numbered(observed, "normalized_name", "seen_id"), numbered(candidates, "normalized_race_name", "listed_id")
    # Pairs carry numbers only; names, dates and words are joined to what is left of them.
    observed = checkpointed(observed.join(shuffled(seen.select(_SEASON, F.col("name").alias("normalized_name"), "seen_id")), [_SEASON, "normalized_name"]).withColumn("observed_id", F.monotonically_increasing_id()))
    candidates = checkpointed(candidates.join(shuffled(listed.select(_SEASON, F.col("name").alias("normalized_race_name"), "listed_id")), [_SEASON, "normalized_race_name"]).withColumn("candidate_id", F.monotonically_increasing_id()))
    score = lambda date_bonus, prefix: F.struct((F.col("shared") + date_bonus + prefix).alias("total"), F.col("shared"), date_bonus.alias("date_bonus"))
    counts = [F.sum("races").alias("races"), F.min("race").alias("race")]
    counted = candidates.select("listed_id", "start_date", "end_date", "races", F.col("candidate_id").alias("race"))

    # Over the season: only three shared words or more reach the least score.
    per_name = counted.groupBy("listed_id").agg(*counts).join(shuffled(listed), "listed_id")
    in_season = per_name.select(_SEASON, "races", "race", F.inline(_sets_of_names(F.col("words"), F.col("long"), 3))).groupBy(_SEASON, "n", "shared_words").agg(*counts)
    in_season = checkpointed(in_season)
    wanted = seen.select(_SEASON, "seen_id", F.inline(_sets_of_names(F.col("words"), F.col("long"), 3)))
    by_season = checkpointed(_largest_sets(wanted, in_season, [_SEASON], "seen_id")).join(shuffled(observed.select("seen_id", "observed_id")), "seen_id")
    by_season = by_season.select("observed_id", "races", "race", score(F.lit(0), F.lit(0)).alias("score"))

    # On a race day: one shared word is enough, so names are first cut to the words of that day.
    dated = observed.where(F.col("day").isNotNull()).select(_SEASON, "observed_id", "seen_id", "day")
    days = counted.where(F.col("start_date") <= F.col("end_date")).select(
        "listed_id", "races", "race", F.explode(F.sequence("start_date", "end_date")).alias("day")
    )
    on_day = days.join(shuffled(listed.select(_SEASON, "listed_id", F.inline(_sets_of_names(F.col("words"), F.col("long"), 1)))), "listed_id")
    on_day = checkpointed(on_day.groupBy(_SEASON, "day", "n", "shared_words").agg(*counts))
    day_words = on_day.where("n = 1").select(_SEASON, "day", F.rtrim("shared_words").alias("word"))
    met = dated.join(shuffled(seen.select("seen_id", "long", F.explode("words").alias("word"))), "seen_id").join(shuffled(day_words), [_SEASON, "day", "word"], "left_semi")
    met = met.groupBy(_SEASON, "day", "observed_id", "long").agg(F.array_sort(F.collect_list("word")).alias("words"))
    wanted = met.select(_SEASON, "day", "observed_id", F.inline(_sets_of_names(F.col("words"), F.col("long"), 1)))
    by_day = checkpointed(_largest_sets(wanted, on_day, [_SEASON, "day"], "observed_id")).select("observed_id", "races", "race", score(F.lit(3), F.lit(0)).alias("score"))

    del in_season, days, dated, on_day, day_words, met, wanted  # the sets are many times the names
    let_go(names.sparkSession)

    # Listed pairs: prefixes, and names of many words that share at least two.
    frequency = listed.select(_SEASON, F.explode("words").alias("word")).groupBy(_SEASON, "word").agg(F.count(F.lit(1)).alias("frequency"))
    rare = lambda sets, id: _rarer_words(sets, id, frequency, 1)
    sharing = rare(seen.where("long"), "seen_id").join(shuffled(rare(listed, "listed_id")), [_SEASON, "word"]).select("seen_id", "listed_id")
    sharing = sharing.union(rare(seen.where("NOT long"), "seen_id").join(shuffled(rare(listed.where("long"), "listed_id")), [_SEASON, "word"]).select("seen_id", "listed_id"))
    compared = checkpointed(
        checkpointed(_prefix_pairs(seen, listed).union(sharing).distinct())
        .join(shuffled(seen.select("seen_id", F.col("name").alias("normalized_name"), F.col("words").alias("ours"))), "seen_id")
        .join(shuffled(listed.select("listed_id", F.col("name").alias("normalized_race_name"), F.col("words").alias("theirs"))), "listed_id")
        .select(
            "seen_id", "listed_id", F.size(F.array_intersect("ours", "theirs")).alias("shared"),
            F.startswith(F.col("normalized_name"), F.col("normalized_race_name")).cast("int").alias("prefix"),
        )
        .where("shared > 0")
    )
    within = F.coalesce(F.col("day").between(F.col("start_date"), F.col("end_date")), F.lit(False))
    pairs = (
        compared.join(shuffled(observed.select("seen_id", "observed_id", "day")), "seen_id")
        .join(shuffled(counted), "listed_id")
        .withColumn("date_bonus", F.when(within, F.lit(3)).otherwise(F.lit(0)))
        # a pair without a prefix that shares one word on its day is counted already
        .where(~((F.col("shared") == 1) & (F.col("date_bonus") == 3) & (F.col("prefix") == 0)))
        .select("observed_id", "races", "race", score(F.col("date_bonus"), F.col("prefix")).alias("score"))
    )
    # the pairs of an observation are summed before they meet what else it has, so that it has few rows there
    pairs = pairs.groupBy("observed_id", "score").agg(*counts).select("observed_id", "races", "race", "score")
    reached = by_season.union(by_day).union(pairs).where("score.total >= 3").repartition("observed_id")
    per_score = reached.groupBy("observed_id", "score").agg(*counts)
    best = per_score.groupBy("observed_id").agg(F.max_by(F.struct("races", "race"), "score").alias("best")).where("best.races = 1")
    best = best.select("observed_id", F.col("best.race").alias("candidate_id")).join(shuffled(observed.select("observed_id", *observation)), "observed_id")
    return best.join(shuffled(candidates.select("candidate_id", "race")), "candidate_id").select(
        *observation, F.col("race.race_id").alias("overlap_race_id"), F.col("race.race_name").alias("overlap_name")
    )


def _with_planned_name(resolved: DataFrame, planning: DataFrame) -> DataFrame:
    """`canonical_race_name` of resolved rows: the name that they bring, else that of the planned race."""
    named = planning.groupBy(_SEASON, F.col("race_id").alias("matched_race_id")).agg(F.min("race_name").alias("_planned_name"))
    joined = resolved.join(shuffled(named), [_SEASON, "matched_race_id"], "left")
    return joined.withColumn("canonical_race_name", first_filled(F.col("_canonical"), text(F.col("_planned_name")))).drop("_canonical", "_planned_name")


def match_programme(programme: DataFrame, planning: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every programme row with matched_race_id, canonical_race_name, matched_via and match_status.

    A spelling on a date is resolved once for all teams that list it. Only aliases can depend on the team: rows whose spelling
    has any are looked up by team as well, and shared words are only looked at where a variant or an alias for all has not decided.
    Rows without a team or a season match nothing.
    """
    nowhere = F.lit(-(2**31))
    observed = programme.withColumns(
        {
            "_source_name": text(F.col("source_race_name")),
            "_observed_date": text(F.col("observed_date")),
            "_season": F.coalesce(F.when(F.col("team_slug").isNotNull(), F.col(_SEASON)), nowhere),
        }
    )
    known = observed.where(F.col("team_slug").isNotNull() & F.col(_SEASON).isNotNull())
    sightings = known.select(_SEASON, F.col("_source_name").alias("source_race_name"), F.col("_observed_date").alias("observed_date")).distinct()
    # written one after the other, so that no plan holds the stages of all matchers
    sightings = checkpointed(sightings)
    in_season = sightings.select(_SEASON, "source_race_name").distinct().join(shuffled(_spellings(sightings, with_variants=True)), "source_race_name")
    in_season = checkpointed(in_season)
    # `_open`: some alias holds for every team and season, so the team and the other matchers make no difference
    everywhere = (F.col("team_slug") == "") & F.col(_SEASON).isNull()
    aliased = aliases.groupBy(F.col("normalized_source_race_name").alias("normalized_name")).agg(F.coalesce(F.max(everywhere), F.lit(False)).alias("_open"))
    by_variant = checkpointed(variant_matches(in_season, planning))
    in_season = in_season.drop("variants").join(shuffled(by_variant), [_SEASON, "source_race_name"], "left").join(shuffled(aliased), "normalized_name", "left")
    in_season = checkpointed(in_season)
    names = checkpointed(sightings.join(shuffled(in_season), [_SEASON, "source_race_name"]))
    undecided = F.col("variant_race_id").isNull() & ~F.coalesce("_open", F.lit(False))
    by_overlap = checkpointed(overlap_matches(names.where(undecided), planning))
    let_go(programme.sparkSession)
    resolved = names.join(shuffled(by_overlap), [_SEASON, "normalized_name", "observed_date"], "left")
    variant, overlap = F.col("variant_race_id").isNotNull(), F.col("overlap_race_id").isNotNull()
    pick = lambda a, b, none: F.when(variant, a).when(overlap, b).otherwise(none)
    resolved = resolved.select(
        _SEASON,
        F.col("source_race_name").alias("_source_name"),
        F.col("observed_date").alias("_observed_date"),
        F.when(F.col("_open").isNotNull(), F.col("normalized_name")).alias("_alias_name"),
        pick(F.col("variant_race_id"), F.col("overlap_race_id"), F.lit(None)).alias("matched_race_id"),
        pick(F.col("variant_name"), F.col("overlap_name"), F.lit("")).alias("_canonical"),
        pick(F.lit("normalized_name"), F.lit("token_overlap"), F.lit("")).alias("matched_via"),
    )
    resolved = checkpointed(_with_planned_name(resolved, planning)).withColumnRenamed(_SEASON, "_season")
    del sightings, names, by_variant, by_overlap
    ids = ["_season", "_source_name", "_observed_date"]

    # which teams list a spelling with an alias
    listing = in_season.where("_open IS NOT NULL").select(_SEASON, F.col("source_race_name").alias("_source_name"), "normalized_name")
    listing = known.select("team_slug", _SEASON, "_source_name").join(shuffled(listing), [_SEASON, "_source_name"])
    by_alias = alias_matches(checkpointed(listing.select("team_slug", _SEASON, "normalized_name").distinct()), aliases)
    del in_season, listing
    by_alias = by_alias.select("team_slug", _SEASON, "normalized_name", F.col("alias_race_id").alias("matched_race_id"), F.col("alias_name").alias("_canonical"), F.lit("alias").alias("matched_via"))
    by_alias = _with_planned_name(by_alias, planning)
    found = ["matched_race_id", "matched_via", "canonical_race_name"]
    by_alias = by_alias.select("team_slug", _SEASON, F.col("normalized_name").alias("_alias_name"), F.struct(*found).alias("_alias"))

    # Both parts join the rows in the same way, so they are dealt to the tasks once. None of the keys can be null, for the same reason.
    met = observed.join(shuffled(resolved), ids, "left")
    of_team = skew_join(met.where(F.col("_alias_name").isNotNull()), by_alias, ["team_slug", _SEASON, "_alias_name"])
    preferred = lambda c: F.when(F.col("_alias").isNotNull(), F.col(f"_alias.{c}")).otherwise(F.col(c)).alias(c)
    rest = [c for c in programme.columns if c not in ("team_slug", _SEASON)]
    columns = ["team_slug", _SEASON, *rest]
    matched = met.where(F.col("_alias_name").isNull()).select(*columns, *found).union(of_team.select(*columns, *map(preferred, found)))
    status = F.when(F.col("matched_race_id").isNotNull(), F.lit("matched")).otherwise(F.lit("unmatched"))
    let_go(programme.sparkSession)
    return matched.withColumn("match_status", status)
