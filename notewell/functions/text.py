"""Column expressions on note texts, tags and their JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_SHARE, TRIGRAM_SHARE = 0.55, 0.45
GRAM_SEED = 1
"""With it no two trigrams of small letters, digits and spaces have one 32-bit hash."""

CHANGE = T.StructType([
    T.StructField("at", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("previous_note", T.StringType()),
    T.StructField("merged_from", T.LongType()),
    T.StructField("rewrote_alias", T.StringType()),
])


def normalized(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def tokens(norm: Column) -> Column:
    """The words of a normalised text that have at least two characters."""
    return F.filter(F.split(norm, " "), lambda t: F.length(t) >= 2)


def trigrams(norm: Column) -> Column:
    """The distinct runs of three characters of a normalised text between two spaces."""
    chars = F.filter(F.split(F.concat(F.lit(" "), norm, F.lit(" ")), ""), lambda c: c != "")
    # The text's characters beside the next and the one after: each is looked at a fixed number of times.
    runs = F.transform(F.array(chars), lambda c: F.zip_with(F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.concat(x, y)), F.slice(c, F.lit(3), F.size(c)), lambda xy, z: F.concat(xy, z)))
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(runs[0], lambda r: r.isNotNull())))


def hashes(items: Column) -> Column:
    """Distinct 64-bit hashes of an array's strings, which array functions intersect faster."""
    return F.array_distinct(F.transform(items, lambda x: F.xxhash64(x)))


def short_hashes(grams: Column) -> Column:
    """Distinct 32-bit hashes of an array's trigrams; those of normalised texts all have different ones."""
    return F.array_distinct(F.transform(grams, lambda x: F.hash(F.lit(GRAM_SEED), x)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two distinct lists; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def similarity(a: Column, b: Column, words_a: Column, words_b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Blend of word and trigram overlap of normalised texts, given their distinct words and trigrams."""
    blend = WORD_SHARE * jaccard(words_a, words_b) + TRIGRAM_SHARE * jaccard(grams_a, grams_b)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(blend)


def similarity_of(a: Column, b: Column) -> Column:
    """similarity() of two normalised texts."""
    words = [F.array_distinct(tokens(x)) for x in (a, b)]
    return similarity(a, b, *words, trigrams(a), trigrams(b))


def boundary_pattern(token: str) -> str:
    """A pattern for token where no letter, digit, underscore, slash or hyphen touches it."""
    return rf"(?<![A-Za-z0-9_/-]){re.escape(token)}(?![A-Za-z0-9_/-])"


def mentions(text: Column, token: str) -> Column:
    return text.rlike(boundary_pattern(token))


def mention_replaced(text: Column, old: str, new: str) -> Column:
    return F.regexp_replace(text, boundary_pattern(old), new.replace("\\", "\\\\").replace("$", "\\$"))


def parsed_tags(tags: Column) -> Column:
    """The strings in a JSON array; none for anything else."""
    items = F.try_variant_get(F.try_parse_json(tags), "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: v.cast("string")), F.array().cast("array<string>"))


def cleaned_tags(tags: Column) -> Column:
    """Trimmed, without blanks and repeats, in their own case."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))


def merged_tags(*tags: Column) -> Column:
    """Lists joined in order, lower-cased, trimmed, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(F.concat(*tags), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def tags_json(tags: Column) -> Column:
    return F.to_json(tags)


def changelog(metadata: Column) -> Column:
    """The changes in a metadata object; none if it has none or isn't an object."""
    found = F.from_json(metadata, T.StructType([T.StructField("changelog", T.ArrayType(CHANGE))]))
    return F.coalesce(found["changelog"], F.array().cast(T.ArrayType(CHANGE)))


def change(**fields: Column) -> Column:
    """A changelog entry; fields that aren't given are left out of its JSON."""
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGE])


def with_changes(metadata: Column, changes: Column) -> Column:
    """metadata with changes appended to its changelog. Its other keys stay as they are."""
    log = F.to_json(F.named_struct(F.lit("changelog"), F.concat(changelog(metadata), changes)))
    others = F.map_filter(F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>"), lambda k, _: k != "changelog")

    def member(e: Column) -> Column:
        name = F.to_json(F.array(e["key"]))
        return F.concat(F.substr(name, F.lit(2), F.length(name) - 2), F.lit(":"), F.to_json(e["value"]))

    joined = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(others), member), ","), F.lit(","), F.substr(log, F.lit(2)))
    return F.when(F.size(others) > 0, joined).otherwise(log)


def longer(kept: Column, other: Column) -> Column:
    """The longer text; kept if they are as long."""
    return F.when(F.length(other) > F.length(kept), other).otherwise(kept)


def snippet(text: Column) -> Column:
    return F.when(F.length(text) > 100, F.concat(F.substr(text, F.lit(1), F.lit(97)), F.lit("..."))).otherwise(text)
