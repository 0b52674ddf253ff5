"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the digest of its content. The ledger has a row per blob and scan: which rules
in which versions were applied, and what they found. A scan applies to each distinct blob only the rules that the ledger
does not have for it, and findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from echelon.llm.common import stored, text_of

_SPAN = "array<struct<start: int, end: int, rule: string>>"
LEDGER = f"blob binary, scanned array<string>, found {_SPAN}"


@dataclass(frozen=True)
class Rule:
    """Non-overlapping matches of `pattern` from the left, dropped if `group` (0: all of it) has under `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a run of 16 or more is the same match as a run of any length that is kept from 16 on
)
RULES = (
    *BASE,
    # a repeated class needs no stack, however long the text; a repeated group does
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", version=2),
    # a bounded header, or each start in a long run would read all of it
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", version=2),
)


def spans(text: Column, rule: Rule) -> Column:
    """Where a rule matches, in code points, end exclusive.

    The text between the matches and the matches themselves alternate, so their lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    between, matches, kept = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, 0), F.regexp_extract_all(text, pattern, rule.group)
    parts = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("before"), matches.alias("match"), kept.alias("kept"))

    def place(done: Column, part: Column) -> Column:
        start = done["place"] + F.char_length(part["before"])
        end = start + F.char_length(part["match"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.name).alias("rule"))
        found = F.when(F.char_length(part["kept"]) >= rule.least, F.concat(done["found"], F.array(one).cast(_SPAN))).otherwise(done["found"])
        return F.struct(end.alias("place"), found.alias("found"))

    start = F.struct(F.lit(0).alias("place"), F.array().cast(_SPAN).alias("found"))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, place, lambda done: done["found"])).otherwise(F.array().cast(_SPAN))


def blob_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: Iterable[Rule] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows: one for each distinct blob of `docs` that lacks a rule in the version given, with what it found."""
    rules = list(rules)
    blobs = docs.select(blob_of(text).alias("blob"), text_of(text).alias("text")).dropDuplicates(["blob"])
    wanted = F.array(*[F.lit(rule.name) for rule in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", wanted)
    else:
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))))
    found = [F.when(F.array_contains("todo", rule.name), spans(F.col("text"), rule)).otherwise(F.array().cast(_SPAN)) for rule in rules]
    return blobs.where(F.size("todo") > 0).select("blob", F.col("todo").alias("scanned"), F.concat(*found).alias("found"))


def findings(docs: DataFrame, ledger: DataFrame, rules: Iterable[Rule] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` (id, blob) with the spans of the rules in their present versions, by start and then by rule."""
    names = F.array(*[F.lit(rule.name) for rule in rules])
    merged = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).where(F.size("found") > 0)
    merged = stored(merged, "found")  # so that a blob of very many rows is dealt to several tasks in the join
    paths = docs.select(F.col(id).alias("id"), blob_of(text).alias("blob"))
    present = F.filter("found", lambda span: F.array_contains(names, span["rule"]))
    placed = F.transform(
        present,
        lambda span: F.struct(span["start"].alias("start"), F.array_position(names, span["rule"]).alias("rank"), span["end"].alias("end"), F.substring_index(span["rule"], "@", 1).alias("kind")),
    )
    none = F.array().cast("array<struct<start: int, rank: bigint, end: int, kind: string>>")
    return paths.join(merged, "blob", "left").select("id", "blob", F.coalesce(F.array_sort(placed), none).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: Iterable[Rule] = RULES, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Spans of every row of `docs`, and the new ledger rows (to be appended to the ledger).

    The first frame has id, n_assign, n_access, n_hex, base_sha256 (digest of the base kinds' spans) and spans (all kinds).
    Each row of `docs` is a path at a version; equal texts are scanned once. A null text counts as empty; without a match
    the counts are 0 and spans is empty. Null ids and repeated rows stay rows of their own, other columns are not read, an
    empty table gives no rows.
    """
    rules = list(rules)
    fresh = stored(scan_unseen(docs, ledger, rules, text), "ledger")
    whole = fresh if ledger is None else ledger.unionByName(fresh)
    found = findings(docs, whole, rules, id, text)
    kinds = [rule.kind for rule in BASE]
    base = F.filter("found", lambda span: span["kind"].isin(kinds))
    held = F.transform("found", lambda span: span["kind"])
    counts = [F.size(F.array_remove(held, other)).cast("long") for other in kinds]
    counts = [(F.size(held) - left).alias(f"n_{kind}") for kind, left in zip(kinds, counts, strict=True)]
    return found.select(F.col("id").alias(id), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")), fresh
