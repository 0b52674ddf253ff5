"""URL verdicts by rules, and for the rest by exact membership in a list of hosts held as a Bloom filter cascade.

The cascade knows every key of the corpus. Level 0 encodes the listed keys. The unlisted keys that pass it are its false
positives; level 1 encodes those, level 2 the listed keys that pass level 1, and so on until no key of the other kind
passes. The first level that a key fails tells its kind, so the answer is exact for all keys of the corpus, and the filters
are a few bits per listed key. They reach the tasks as one array per level through a scalar subquery; no row is joined.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from echelon.llm.common import fresh_path, stored

BITS_PER_KEY = 8
HASHES = 5
#: Longs of all levels that may be sent to the tasks (8 MB).
MOST_WORDS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule for a host, its subdomains and all paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else the empty text."""
    return F.translate(_after(url, r"^([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else the empty text."""
    return _after(url, r"^[^/?#]*([^?#]*)")


def _after(url: Column, pattern: str) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.regexp_extract(url.substr(place + 3, F.char_length(url)), pattern, 1)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does. Meant for a list that is written by hand."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: (len(rule.name), rule.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


@dataclass(frozen=True)
class Cascade:
    """Filters in a table (level, words); `bits[i]` is the size of level i."""

    path: str
    bits: tuple[int, ...]

    def _passes(self, frame: DataFrame, key: Column, level: int) -> Column:
        spark = frame.sparkSession
        words = spark.read.schema("level int, words array<bigint>").parquet(self.path).where(F.col("level") == level).select("words").scalar()
        tests = [F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1 for place in _places(key, level, self.bits[level])]
        passes = tests[0]
        for test in tests[1:]:
            passes = passes & test
        return passes

    def listed(self, frame: DataFrame, key: Column) -> Column:
        """Whether a key of the corpus is listed: the first level that it fails decides."""
        answer = F.lit(len(self.bits) % 2 == 1)
        for level in reversed(range(len(self.bits))):
            answer = F.when(self._passes(frame, key, level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def build_cascade(keys: DataFrame) -> Cascade | None:
    """The cascade over `keys` (key, listed: one row per key of the corpus). None if it would exceed `MOST_WORDS`."""
    spark = keys.sparkSession
    keys = stored(keys.select("key", "listed"), "keys")
    cascade = Cascade(fresh_path(spark, "cascade"), ())
    words = 0
    while True:
        level = len(cascade.bits)
        open_keys = keys
        for passed in range(level):
            open_keys = open_keys.where(cascade._passes(keys, F.col("key"), passed))
        members = open_keys.where(F.col("listed") == F.lit(level % 2 == 0)).select("key")
        count = members.count()
        if count == 0 and level:
            return cascade
        size = max(1, -(-count * BITS_PER_KEY // 64))
        words += size
        if words > MOST_WORDS:
            return None
        places = members.select(F.explode(F.array(*_places(F.col("key"), level, size * 64))).alias("place"))
        set_bits = places.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bits"))
        every = set_bits.union(spark.range(size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
        filled = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        # at most MOST_WORDS rows in all come together here
        row = filled.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("pairs")).select(F.lit(level).alias("level"), F.expr("transform(pairs, pair -> pair.bits)").alias("words"))
        row.write.mode("append").parquet(cascade.path)
        cascade = Cascade(cascade.path, (*cascade.bits, size * 64))


def tracked_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Hosts of which more than half of the pages' urls carry a tracking parameter (utm_*, ref, gclid, fbclid)."""
    tracked = F.coalesce(F.col(url).rlike(r"[?&](?:utm_[a-z]+|ref|gclid|fbclid)="), F.lit(False))
    per_host = pages.select(host_of(F.col(url)).alias("key"), tracked.cast("int").alias("tracked")).groupBy("key").agg(F.sum("tracked").alias("tracked"), F.count("*").alias("pages"))
    return per_host.where("tracked * 2 > pages").select("key")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Iterable[Rule] = (), id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of `pages`: id, host, path, rule and verdict (`allow` or `block`).

    `listed` has the blocked hosts in a column `key`; hosts outside the corpus and repeated or null ones are of no effect.
    The rule's verdict holds where a rule fits; elsewhere listed hosts are blocked. A null url, or one without `://`, has an
    empty host and path. Repeated rows and null ids stay rows of their own, other columns are not read, an empty table gives
    no rows.
    """
    rules = list(rules)
    kept = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    corpus = kept.select(F.col("host").alias("key"), F.lit(False).alias("listed")).union(listed.select("key", F.lit(True).alias("listed")).where("key IS NOT NULL"))
    # a key of the corpus has a row that is not listed
    keys = corpus.groupBy("key").agg(F.max("listed").alias("listed"), F.min("listed").alias("elsewhere")).where("NOT elsewhere").select("key", "listed")
    cascade = build_cascade(keys)
    if cascade is not None:
        kept = kept.withColumn("listed", cascade.listed(kept, F.col("host")))
    else:  # too long a list to send to the tasks
        kept = kept.join(keys.where("listed").select(F.col("key").alias("host"), F.lit(True).alias("found")), "host", "left").withColumn("listed", F.coalesce("found", F.lit(False)))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return kept.select(F.col("id").alias(id), "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
