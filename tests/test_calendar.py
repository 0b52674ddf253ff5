"""Names, matching against brute force, calendar assembly and schedule diffs."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from echelon.constants import NAME_STOP_WORDS
from echelon.functions.dates import label_dates
from echelon.functions.text import name_tokens, name_variants, normalise_name, race_slug, stable_slug
from echelon.operators import matching, team_calendar as cal

PLANNED = "race_id long, race_name string, category string, date_label string, month int, year int"
NO_ALIAS = "team_slug string, planning_year int, source_race_name string, canonical_race_name string, race_id long, alias_order long"


def test_names_slugs_and_labels(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(normalise_name(F.lit("Étoile de Bessèges & Straße ME"))) == "etoile de besseges and strasse"
    assert value(normalise_name(F.lit(None).cast("string"))) == ""
    # what decomposes into marks only vanishes, too
    assert value(normalise_name(F.lit("Ga\uff9ela \u0f73Cup\uff9f"))) == "gala cup"
    assert value(name_variants(F.lit("Clàssica Valenciana - Gran Premi WE"))) == ["classica valenciana gran premi", "classica valenciana"]
    assert value(name_tokens(F.lit("Tour of the Alps 2026 Alps"))) == ["alps"]
    assert value(race_slug(F.lit("race/giro-d-italia/2026/startlist"))) == "giro-d-italia"
    assert value(race_slug(F.lit("https://x.org/team-in-race/u-2026/giro/points"))) == "giro"
    assert value(stable_slug(F.lit("cofidis-2026"), F.lit(2026))) == "cofidis"
    days = value(label_dates(F.lit("30.12-02.01"), F.lit(2026)))
    assert (days.start_date, days.end_date) == (date(2026, 12, 30), date(2027, 1, 2))
    assert value(label_dates(F.lit("31.02"), F.lit(2026))).error is not None


def brute_force(name, day, planned):
    """Best race by the written score rule over all planned rows."""
    words = lambda n: {w for w in n.split() if w not in NAME_STOP_WORDS and not w.isdigit()}
    scores = []
    for race_id, other, start, end in planned:
        shared = len(words(name) & words(other))
        if shared:
            bonus = 3 if day and start and start <= day <= end else 0
            scores.append(((shared + bonus + int(name.startswith(other)), shared, bonus), race_id))
    scores.sort(reverse=True)
    if scores and scores[0][0][0] >= 3 and (len(scores) == 1 or scores[0][0] > scores[1][0]):
        return scores[0][1]
    return None


def test_overlap_matches_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["alpha", "beta", "gamma", "delta", "epsilon", "tour", "of"]
    phrase = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5)))
    planned = []
    for i in range(60):
        start = date(2026, 1, 1) + timedelta(days=rng.randrange(40))
        planned.append((i, phrase(), start, start + timedelta(days=rng.randrange(4))))
    observed = sorted({(phrase(), rng.choice(["", str(date(2026, 1, 1) + timedelta(days=rng.randrange(40)))])) for _ in range(250)})
    calendar = spark.createDataFrame([(i, n, s, e, 2026, n) for i, n, s, e in planned], "race_id long, race_name string, start_date date, end_date date, planning_year int, normalized_race_name string")
    names = spark.createDataFrame([(2026, n, d) for n, d in observed], "planning_year int, normalized_name string, observed_date string")
    got = {(r.normalized_name, r.observed_date): r.overlap_race_id for r in matching.overlap_matches(names, calendar).collect()}
    for name, day in observed:
        assert got.get((name, day)) == brute_force(name, date.fromisoformat(day) if day else None, planned), (name, day)


def matched_as_by_hand(spark, planned, observed):
    calendar = spark.createDataFrame([(i, n, s, e, 2026, n) for i, n, s, e in planned], "race_id long, race_name string, start_date date, end_date date, planning_year int, normalized_race_name string")
    names = spark.createDataFrame([(2026, n, d) for n, d in observed], "planning_year int, normalized_name string, observed_date string")
    got = {(r.normalized_name, r.observed_date): r.overlap_race_id for r in matching.overlap_matches(names, calendar).collect()}
    for name, day in observed:
        assert got.get((name, day)) == brute_force(name, date.fromisoformat(day) if day else None, planned), (name, day)
    return got


def test_overlap_of_long_names_and_common_words(spark, monkeypatch):
    """Names on both sides of the limit, all with the same three words, with prefixes and repeated words."""
    monkeypatch.setattr(matching, "MOST_WORDS", 5)
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(9)]
    phrase = lambda: " ".join(["alpha", "beta", "gamma", *(rng.choice(vocabulary) for _ in range(rng.randrange(0, 6)))])
    day = lambda: date(2026, 1, 1) + timedelta(days=rng.randrange(25))
    planned = [(i, phrase(), start, start + timedelta(days=rng.randrange(3))) for i, start in enumerate(day() for _ in range(50))]
    planned += [(90, "alpha beta gamma", None, None), (91, planned[0][1], planned[0][2], planned[0][2]), (92, "solo", day(), date(2026, 2, 1))]
    observed = {(phrase(), rng.choice(["", str(day())])) for _ in range(150)}
    observed |= {(p[1] + " word1 extra", rng.choice(["", str(p[2] or day())])) for p in planned} | {("solo gamma", "2026-01-30"), ("nothing", "2026-01-05")}
    got = matched_as_by_hand(spark, planned, sorted(observed))
    assert len(got) > 20


def test_overlap_lists_no_pairs_of_common_words(spark):
    """A thousand races and a thousand names that share three words: what is joined grows with the names, not with the pairs."""
    planned = [(i, f"alpha beta gamma own{i}", date(2026, 1, 1), date(2026, 1, 2)) for i in range(1000)]
    observed = [(f"gamma alpha beta other{i} own{i}", "2026-01-01" if i % 2 else "") for i in range(1000)]
    calendar = spark.createDataFrame([(i, n, s, e, 2026, n) for i, n, s, e in planned], "race_id long, race_name string, start_date date, end_date date, planning_year int, normalized_race_name string")
    names = spark.createDataFrame([(2026, n, d) for n, d in observed], "planning_year int, normalized_name string, observed_date string")
    joined = []
    largest = matching._largest_sets

    def counted(wanted, sets, keys, id):
        joined.append(matching.skew_join(wanted, sets, [*keys, "n", "shared_words"], "inner").count())
        return largest(wanted, sets, keys, id)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(matching, "_largest_sets", counted)
        got = matching.overlap_matches(names, calendar).collect()
    assert {(r.normalized_name, r.overlap_race_id) for r in got} == {(name, i) for i, (name, _) in enumerate(observed)}
    assert max(joined) <= 16 * len(observed)


def test_cascade_and_calendar(spark):
    planned = spark.createDataFrame(
        [(97, "GP la Marseillaise", "1.1", "01.02", 2, 2026), (5, "Étoile de Bessèges", "2.1", "04.02-08.02", 2, 2026), (6, "Clásica Almería", "1.Pro", "08.02", 2, 2026)], PLANNED
    )
    aliases = matching.prepare_aliases(spark.createDataFrame([("unibet-2026", 2026, "Grand Prix Cycliste la Marseillaise", "GP la Marseillaise", 97, 0)], NO_ALIAS))
    rows = [("Grand Prix Cycliste la Marseillaise", "2026-02-01"), ("Etoile de Besseges - Tour du Gard", "2026-02-04"), ("Costa de Almeria", "2026-02-08"), ("Unknown", "2026-05-05")]
    programme = spark.createDataFrame([("unibet", "Unibet", 2026, "team_program_live", n, d) for n, d in rows], "team_slug string, team_name string, planning_year int, source string, source_race_name string, observed_date string")
    planning = cal.prepare_planning(planned)
    matched = {r.source_race_name: (r.matched_race_id, r.matched_via, r.match_status) for r in matching.match_programme(programme, planning, aliases).collect()}
    assert matched[rows[0][0]] == (97, "alias", "matched")
    assert matched[rows[1][0]] == (5, "normalized_name", "matched")
    assert matched[rows[2][0]] == (6, "token_overlap", "matched")
    assert matched["Unknown"] == (None, "", "unmatched")
    calendar = {r.race_id: r for r in cal.calendar_from_programme(programme, planning, aliases, "2026-02-08").collect()}
    assert calendar[5].overlap_group == calendar[6].overlap_group == "overlap_2" and calendar[97].overlap_group == ""
    assert calendar[97].status == "completed" and calendar[6].status == "scheduled"
    assert calendar[5].race_name == "Étoile de Bessèges" and calendar[5].category == "2.1"


def test_schedule_changes(spark):
    schema = "team_slug string, planning_year int, race_id long, race_name string, date_label string, category string, status string, team_calendar_status string, notes string"
    previous = spark.createDataFrame([("t", 2026, 1, "A", "01.02", "1.1", "completed", "active", ""), ("t", 2026, 3, "C", "01.03", "1.1", "scheduled", None, "")], schema)
    latest = spark.createDataFrame([("t", 2026, 1, "A", "01.02", "1.1", "scheduled", "active", ""), ("t", 2026, 2, "B", "02.02", "1.1", "scheduled", "active", "")], schema)
    now = F.lit("2026-01-01").cast("timestamp")
    changes = {(r.race_id, r.change_type, r.old_value, r.new_value) for r in cal.schedule_changes(previous, latest, now).collect()}
    assert changes == {(1, "status_changed", "completed", "scheduled"), (2, "race_added", "", "scheduled"), (3, "race_removed", "scheduled", "")}
    assert cal.schedule_changes(latest, latest, now).count() == 0
