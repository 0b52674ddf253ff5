"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once. The high bits of the hash choose a bin, and each bin keeps its smallest hash. An empty bin
takes the value of another bin: it tries the bins in a pseudo-random order of its own, the same for all documents, until
one is not empty. Of each value only the low-order bits are kept, packed as hexadecimal digits. Values that differ agree in
b bits by chance with probability 2^-b; the likeness of two fingerprints is corrected for that.

All of this is one column expression. The neighbour of a document is found over the ids alone; of the neighbours' texts
only as many code points travel as the edit takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from echelon.llm.common import stored, text_of, word_hashes

BINS = 128
BITS = 8
WORDS = 5
_KEY = ("id0", "no_id", "content")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """One hash per run of `size` words; a shorter text is a single shingle, no words give none.

    `words` is used several times for each run, so it should be a column or come from `let`.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _bin_minima(shingles: Column, bins: int) -> Column:
    """The smallest hash of each bin in the order of the bins, null for an empty one.

    The largest value of every bin is added before sorting, so each bin has a first element, and that value means empty.
    """
    low = 64 - (bins.bit_length() - 1)
    ones = F.lit((1 << low) - 1)
    tops = F.transform(F.sequence(F.lit(-bins // 2), F.lit(bins // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), low).bitwiseOR(ones))
    return let(
        F.array_sort(F.concat(shingles, tops)),
        lambda ordered: F.transform(
            F.filter(ordered, lambda value, i: (i == 0) | (F.shiftright(value, low) != F.shiftright(F.get(ordered, i - 1), low))),
            lambda value: F.when(value.bitwiseAND(ones) != ones, value),
        ),
    )


def _densified(minima: Column, bins: int) -> Column:
    """Empty bins filled: bin i tries bin (m * (a xor x) + c) mod bins for a = 0, 1, ..., with odd m, x and c drawn from i."""

    def filled(value: Column, i: Column) -> Column:
        drawn = F.xxhash64(i, F.lit("densify"))
        odd, mask, shift = (F.shiftright(drawn, 40 - 16 * k).bitwiseAND(bins - 1) for k in range(3))
        tries = [F.get(minima, ((odd.bitwiseOR(F.lit(1))) * (F.lit(a).bitwiseXOR(mask)) + shift).bitwiseAND(bins - 1).cast("int")) for a in range(bins)]
        return F.coalesce(value, *tries)

    return F.transform(minima, filled)


def fingerprint(text: str | Column, bins: int = BINS, bits: int = BITS, size: int = WORDS) -> Column:
    """The fingerprint of a text column: bins * bits / 4 hexadecimal digits, empty for a text without words."""
    if bins & (bins - 1) or not 2 <= bins <= 4096 or bits not in (4, 8, 12, 16):
        raise ValueError("bins must be a power of two up to 4096, and bits 4, 8, 12 or 16")
    low = (1 << bits) - 1

    def packed(minima: Column) -> Column:
        digits = F.transform(_densified(minima, bins), lambda value: F.substring(F.hex(value.bitwiseAND(low).bitwiseOR(F.lit(low + 1))), 2, bits // 4))
        return F.lower(F.array_join(digits, ""))

    def of(words: Column) -> Column:
        return F.when(F.size(words) == 0, F.lit("")).otherwise(let(_bin_minima(shingle_hashes(words, size), bins), packed))

    return let(word_hashes(text), of)


def likeness(one: str | Column, other: str | Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated resemblance of two fingerprints, 0 to 1. Two empty ones are alike (1), an empty and a full one are not (0)."""
    one, other = (F.col(x) if isinstance(x, str) else x for x in (one, other))
    width = bits // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: one.substr(i * width + 1, F.lit(width)) == other.substr(i * width + 1, F.lit(width))))
    chance = 2.0**-bits
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when(one == other, F.lit(1.0)).when((one == "") | (other == ""), F.lit(0.0)).otherwise(corrected)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows under a key without nulls; rows with the same id and text share it."""
    value = text_of(text)
    kind = docs.schema[id].dataType.simpleString()
    zero = F.lit(0).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else F.lit("").cast(kind)
    return docs.select(F.col(id).alias("id"), F.coalesce(F.col(id), zero).alias("id0"), F.col(id).isNull().alias("no_id"), F.xxhash64(value).alias("content"), value.alias("text"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """Each key with the key after it in the order of descending ids (after the last: the first), by ranges of ids.

    `times` tells how often the pair occurs: of n equal rows n - 1 are followed by their own like.
    """
    keys = rows.groupBy("id", *_KEY).agg(F.count("*").alias("copies"), F.first(F.char_length("text")).alias("length"))
    order = [F.col("no_id").asc(), F.col("id0").desc(), F.col("content").asc()]
    ranged = stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "keys")
    here = F.struct(*_KEY)
    inside = Window.partitionBy("part").orderBy(*order)
    linked = ranged.withColumn("following", F.lead(here).over(inside))
    # a row for each range: at most as many as there are shuffle partitions
    firsts = ranged.groupBy("part").agg(F.min_by(here, F.struct("no_id", *_descending(ranged), "content")).alias("first"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(over)).alias("head"))
    linked = linked.join(F.broadcast(heads), "part").withColumn("following", F.coalesce("following", "head"))
    after = linked.select("id", *_KEY, "length", "following", F.lit(1).cast("long").alias("times"))
    own = linked.where("copies > 1").select("id", *_KEY, "length", here.alias("following"), (F.col("copies") - 1).alias("times"))
    return stored(after.union(own), "pairs")


def _descending(frame: DataFrame) -> list[Column]:
    """The id as a value that sorts the other way round."""
    kind = frame.schema["id0"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return [F.bitwise_not("id0")]
    raise TypeError(f"ids must be integers, not {kind}")


def fingerprint_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS, size: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced by the head of the next document.

    One row per row of `docs`: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next
    document is the one with the next lower id; among equal ids the order is that of a hash of the text, equal rows follow
    each other, null ids come last, and after the last comes the first. A null text counts as empty; a text without words
    has the empty fingerprint. Other columns of `docs` are not read. A table of one row is its own next document; an empty
    table gives no rows.
    """
    rows = _keyed(docs, id, text)
    pairs = _neighbours(rows)
    texts = rows.select(*_KEY, "text").dropDuplicates(list(_KEY))
    taken = F.floor(F.col("length") / 3).cast("int")
    following = [F.col(f"following.{c}").alias(f"next_{c}") for c in _KEY]
    wanted = pairs.select(*following, taken.alias("taken"), *[F.col(c).alias(f"for_{c}") for c in _KEY], "id", "length", "times")
    heads = texts.join(wanted, [F.col(c) == F.col(f"next_{c}") for c in _KEY])
    heads = heads.select(*[F.col(f"{part}_{c}") for part in ("for", "next") for c in _KEY], "id", "length", "times", F.col("text").substr(F.lit(1), F.col("taken")).alias("head"))
    edits = (
        texts.join(heads, [F.col(c) == F.col(f"for_{c}") for c in _KEY])
        .withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("length") - taken), "head"))
        .select(
            "id", "length", "times", *_KEY, *[f"next_{c}" for c in _KEY], F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint("text", bins, bits, size).alias("fingerprint"), fingerprint("edited", bins, bits, size).alias("edited_fingerprint"),
        )
    )
    done = stored(edits, "fingerprints")
    own = done.select(*[F.col(c).alias(f"next_{c}") for c in _KEY], F.col("fingerprint").alias("next_fingerprint")).dropDuplicates([f"next_{c}" for c in _KEY])
    result = done.drop(*_KEY).join(own, [f"next_{c}" for c in _KEY])
    return result.select(
        F.col("id").alias(id),
        F.col("length").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", bins, bits).alias("near_edited"),
        likeness("fingerprint", "next_fingerprint", bins, bits).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")
