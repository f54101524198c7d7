"""Project keys: aliases, resolution, siblings, merges and mentions in notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.functions.text import change, mention_replaced, mentions, normalized, with_changes
from notewell.functions.urls import folder_key, remote_key, tail


def alias_upserted(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """aliases with new(alias, canonical, created_at) added or repointed. Keys are trimmed, blank ones ignored; created_at stays as it was."""
    rows = new.select(F.trim("alias").alias("alias"), F.trim("canonical").alias("canonical"), "created_at").where("alias <> '' AND canonical <> ''")
    both = aliases.alias("a").join(rows.alias("n"), F.col("a.alias") == F.col("n.alias"), "full")
    return both.select(F.coalesce("a.alias", "n.alias").alias("alias"), F.coalesce("n.canonical", "a.canonical").alias("canonical"), F.coalesce("a.created_at", "n.created_at").alias("created_at"))


def looked_up(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """keys(key) with canonical: one step along the aliases, null if the key has none."""
    return keys.join(aliases.select(F.col("alias").alias("key"), "canonical"), "key", "left")


def alias_lists(aliases: DataFrame) -> DataFrame:
    """(canonical, aliases): each canonical key's aliases, sorted."""
    return aliases.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def workspaces(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, canonical, source, linked) of rows(id, path, remote): the remote's key, or else the folder's.

    linked are the aliases to record: the key itself, and the folder's name
    unless it leads elsewhere.
    """
    keyed = rows.select("id", folder_key(F.col("path")).alias("folder"), remote_key(F.col("remote")).alias("remote_key"))
    own = keyed.withColumn("canonical", F.coalesce("remote_key", "folder")).withColumn("source", F.when(F.col("remote_key").isNotNull(), "git").otherwise("folder"))
    known = own.join(aliases.select(F.col("alias").alias("folder"), F.col("canonical").alias("taken")), "folder", "left")
    linked = F.array_distinct(F.when(F.col("taken").isNull(), F.array("canonical", "folder")).otherwise(F.array("canonical")))
    return known.select("id", "canonical", "source", linked.alias("linked"))


def resolved(inputs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, canonical, source) of inputs(id, input, workspace).

    Blank: the workspace's key. A known alias: where it leads, one step. A key
    with the workspace's last part: the workspace's. Anything else: itself.
    """
    asked = inputs.select("id", F.trim("input").alias("key"), "workspace")
    found = looked_up(asked, aliases)
    blank = F.coalesce(F.col("key"), F.lit("")) == ""
    same = (F.col("workspace") != F.col("key")) & ((tail(F.col("workspace")) == tail(F.col("key"))) | (tail(F.col("key")) == F.col("workspace")))
    canonical = F.when(blank, F.col("workspace")).when(F.col("canonical").isNotNull(), F.col("canonical")).when(same, F.col("workspace")).otherwise(F.col("key"))
    source = F.when(blank, "workspace").when(F.col("canonical").isNotNull() | same, "alias").otherwise("input")
    return found.select("id", canonical.alias("canonical"), source.alias("source"))


def links_of(inputs: DataFrame, aliases: DataFrame, now: int) -> DataFrame:
    """(alias, canonical, created_at): what resolving inputs(id, input, workspace) teaches: keys that led to another one."""
    found = resolved(inputs, aliases).join(inputs.select("id", F.trim("input").alias("alias")), "id")
    return found.where((F.col("source") == "alias") & (F.col("alias") != F.col("canonical"))).select("alias", "canonical", F.lit(now).cast("long").alias("created_at")).distinct()


def workspace_payload(found: DataFrame) -> DataFrame:
    """(id, payload): workspaces() as JSON."""
    return found.select("id", F.to_json(F.struct("canonical", "source", F.col("linked").alias("aliases"))).alias("payload"))


def siblings(memories: DataFrame, canonical: str) -> DataFrame:
    """(repo, rows): other keys that look like this one, and the rows under them."""
    last = canonical.split("/")[-1]
    counted = memories.where(F.col("repo") != canonical).groupBy("repo").agg(F.count(F.lit(1)).alias("rows"))
    end = tail(F.col("repo"))
    return counted.where((end == last) | (end == canonical) | (F.col("repo") == last))


def mentioning(memories: DataFrame, alias: str, canonical: str) -> DataFrame:
    """(row_id, repo, note): rows of a repo whose notes mention another key as a word of its own."""
    return memories.where(F.col("repo") == canonical).where(mentions(F.col("note"), alias)).select("row_id", "repo", "note")


def rewritten(memories: DataFrame, old: str, new: str, now: int) -> DataFrame:
    """memories, in any repo, with mentions of an old key replaced, noted in the changelog."""
    hit = mentions(F.col("note"), old)
    note = mention_replaced(F.col("note"), old, new)
    entry = change(at=F.lit(now), action=F.lit("alias_rewrite"), previous_note=F.col("note"), rewrote_alias=F.lit(old))
    changed = {"note": note, "note_normalized": normalized(note), "metadata_json": with_changes(F.col("metadata_json"), F.array(entry)), "updated_at": F.lit(now).cast("long")}
    return memories.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in memories.columns])


def merged(memories: DataFrame, aliases: DataFrame, old: str, new: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """memories and aliases after one key takes the place of another, and (moved_aliases, moved_memories, rewritten_notes).

    Rows stored under the old key, or under any alias of either, move.
    """
    spark = memories.sparkSession
    if old == new:
        return memories, aliases, spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("moved_aliases", "moved_memories", "rewritten_notes")])
    pointed = aliases.select("alias", F.when(F.col("canonical") == old, F.lit(new)).otherwise(F.col("canonical")).alias("canonical"), "created_at")
    sources = pointed.where(F.col("canonical") == new).select(F.col("alias").alias("repo")).unionByName(spark.range(1).select(F.lit(old).alias("repo"))).where(F.col("repo") != new).distinct().withColumn("moves", F.lit(1))
    tagged = memories.join(sources, "repo", "left")
    moved = tagged.select(*[F.when(F.col("moves") == 1, F.lit(new)).otherwise(F.col("repo")).alias(c) if c == "repo" else F.col(c) for c in memories.columns])
    counts = [
        aliases.where(F.col("canonical") == old).agg(F.count(F.lit(1)).alias("moved_aliases")),
        tagged.agg(F.count("moves").alias("moved_memories")),
        memories.agg(F.count_if(mentions(F.col("note"), old)).alias("rewritten_notes")),
    ]
    numbers = spark.range(1).select(*[c.scalar().alias(c.columns[0]) for c in counts])
    links = spark.createDataFrame([(old, new, now), (new, new, now)], "alias string, canonical string, created_at long")
    return rewritten(moved, old, new, now), alias_upserted(pointed, links), numbers
