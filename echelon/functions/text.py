"""Race names, slugs and numbers as column expressions (no Python per row)."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from echelon.constants import NAME_STOP_WORDS, NAME_SUFFIX_WORDS
from echelon.functions.columns import text

_NO_WORD = r"[^\p{L}\p{N}_]+"
_NOT_ASCII = r"[^\x00-\x7F]"
_SUFFIX = "|".join(NAME_SUFFIX_WORDS)


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, str, dict[str, str]]:
    """(characters folding to one ASCII character, those characters, marks to delete, longer foldings).

    Derived from the Unicode tables: compatibility decomposition, combining marks
    dropped, casefold. Only foldings that leave an ASCII character matter, because
    everything else becomes a space later on.
    """
    single, target, marks, longer = [], [], [], {}
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        if 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFKD", char)
        folded = "".join(c for c in parts if not unicodedata.combining(c)).casefold()
        if not folded:  # made of marks only
            marks.append(char)
            continue
        if folded == char or not any(c.isascii() for c in folded):
            continue
        if len(folded) == 1:
            single.append(char)
            target.append(folded)
        else:
            longer[char] = folded
    return "".join(single), "".join(target), "".join(marks), longer


def fold_to_ascii(value: Column) -> Column:
    """Lower case without accents; letters that have no ASCII base are kept as they are."""
    single, target, marks, longer = _folding_tables()
    table = F.from_json(F.lit(json.dumps(longer, ensure_ascii=False)), "map<string,string>")
    # Ligatures, sharp s, fractions and the like become several characters: each distinct one
    # that occurs is replaced. Plain ASCII text skips all of this.
    occurring = F.array_distinct(F.regexp_extract_all(value, F.lit(f"({_NOT_ASCII})"), F.lit(1)))
    spelled = F.aggregate(occurring, value, lambda acc, c: F.coalesce(F.replace(acc, c, F.element_at(table, c)), acc))
    return F.lower(F.when(value.rlike(_NOT_ASCII), F.translate(spelled, single + marks, target)).otherwise(value))


def normalise_name(value: Column) -> Column:
    """Comparable form of a race name: ASCII words in lower case, gender suffix words dropped."""
    folded = F.replace(fold_to_ascii(text(value)), F.lit("&"), F.lit(" and "))
    words = F.concat(F.lit(" "), F.regexp_replace(folded, _NO_WORD, " "), F.lit(" "))
    unsuffixed = F.regexp_replace(words, rf"(?i)(?<= )(?:{_SUFFIX})(?= )", " ")
    return F.trim(F.regexp_replace(unsuffixed, "[^a-z0-9]+", " "))


def name_variants(value: Column) -> Column:
    """Distinct non-empty normalised spellings in the order they should be tried."""
    raw = F.trim(text(value))
    without_suffix = F.regexp_replace(raw, rf"(?i)[\s\p{{Z}}]+(?:{_SUFFIX})$", "")
    head = lambda mark: F.when(F.contains(raw, F.lit(mark)), F.substring_index(raw, mark, 1)).otherwise(raw)
    unquoted = F.regexp_replace(raw, '["“”].*?["“”]', "")
    spellings = F.array_distinct(F.array(raw, without_suffix, head(" - "), head(" / "), unquoted))
    return F.array_distinct(F.filter(F.transform(spellings, normalise_name), lambda v: v != ""))


def tokens_of(normalised: Column) -> Column:
    """Distinct words of a normalised name without stop words and plain numbers, sorted."""
    words = F.array_except(F.split(normalised, " "), F.array(F.lit(""), *[F.lit(w) for w in NAME_STOP_WORDS]))
    return F.array_sort(F.filter(words, lambda w: ~w.rlike("^[0-9]+$")))


def name_tokens(value: Column) -> Column:
    return tokens_of(normalise_name(value))


def stable_slug(slug: Column, year: Column) -> Column:
    """Team slug without its `-<year>` ending; untouched when the year is unknown."""
    cleaned = F.trim(text(slug))
    ending = F.concat(F.lit("-"), year.cast("string"))
    cut = F.left(cleaned, F.length(cleaned) - F.length(ending))
    return F.when(F.coalesce(F.endswith(cleaned, ending), F.lit(False)), cut).otherwise(cleaned)


def artifact_stem(slug: Column, year: Column) -> Column:
    return F.concat(F.replace(stable_slug(slug, year), F.lit("-"), F.lit("_")), F.lit("_"), year.cast("string"))


def lenient_number(value: Column) -> Column:
    """Number with thousands commas; blanks, dashes and anything unreadable are 0."""
    cleaned = F.trim(F.replace(text(value), F.lit(","), F.lit("")))
    return F.coalesce(cleaned.try_cast("double"), F.lit(0.0))


def strict_number(value: Column) -> Column:
    """As `lenient_number` with typographic minus signs read; unreadable text becomes null."""
    cleaned = F.trim(F.translate(text(value), "\xa0−–,", " --"))
    return F.when(cleaned.isin("", "-", "--"), F.lit(0.0)).otherwise(cleaned.try_cast("double"))


def digits_only(value: Column) -> Column:
    cleaned = F.trim(text(value))
    return F.when(cleaned.rlike("^[0-9]+$"), cleaned.try_cast("long"))


def _path_parts(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")


def slug_after(href: Column, prefix: str) -> Column:
    """Second path part of a relative link that starts with `prefix`, else an empty string."""
    parts = _path_parts(text(href))
    return F.when((F.size(parts) >= 2) & (parts[0] == prefix), F.get(parts, F.lit(1))).otherwise(F.lit(""))


def race_slug(url: Column) -> Column:
    """Race slug of `race/<slug>/…` and `team-in-race/<team>/<slug>/…` links, relative or absolute."""
    link = F.trim(text(url))
    absolute = F.regexp_replace(F.regexp_replace(link, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?", ""), r"[?#].*$", "")
    parts = _path_parts(F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), absolute).otherwise(link))
    return (
        F.when((F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "race"), F.get(parts, F.lit(1)))
        .when((F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "team-in-race"), F.get(parts, F.lit(2)))
        .otherwise(F.lit(""))
    )


def heading_year(heading: Column) -> Column:
    """Year at the start of a heading, null when it does not start with four digits."""
    return F.regexp_extract(text(heading), "^([0-9]{4})", 1).try_cast("int")
