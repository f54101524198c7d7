"""Near-duplicate lines by an exact set-similarity join, in SQL functions alone.

A line is the set of its words, which white space separates, in lower case. A
line of at least `least` words goes if an earlier such line, by doc_id and line
number, has a Jaccard similarity of 0.8 or more; the first of its kind stays,
and shorter lines all stay. The query and the pipeline take every line that has
a word (`least` is 1). Words are compared by their 64-bit hashes.

1. Words are counted in BUCKETS buckets, a table of fixed size. Each line gets
   one row: its length, two hashes and a sketch of its set, its words with the
   smallest hashes, and its prefix, the rarest words that it must share one of
   with any similar line. Each of its 96 bits says whether an odd number of
   the set's words fall on it: bits that differ between two lines are at most
   as many as the words that only one of them has.
2. Lines of equal sets meet by their hashes; their first is taken on. Sets of
   fewer than SMALL words are as similar as that to their equals alone, so this
   settles them, and the next steps leave them out.
3. Lines that share a word with the smallest hashes are compared with the first
   of those that share it. This settles nearly all of a large group of near
   copies at about the group's own size.
4. The others meet by the words of their prefixes. Length, position and the
   sketches, each a bound of the overlap, filter the pairs within the join.
5. Each line is compared first with the one that shares most words of its
   prefix. This settles most lines, so that few of a group's pairs are left.
6. The pairs of lines that are still open, if their prefixes allow it, are
   verified on the whole sets, every one.

Defined results: a null text stays null and an empty one empty; rows that share
a doc_id are one document and repeated rows go the same way; rows without
doc_id come before all others; an empty table gives no rows; all columns are
kept, whatever their names, text alone is changed, and n_removed is added, in
place of a column of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.llm.frames import dropped, written

LEAST, PERCENT = 5, 80
SMALL = 4
"""Of two unequal sets of which one has fewer words, at most 3 of 4 are shared."""
BUCKETS = 1 << 16
PICKED = 2
SENT_WHOLE = 1_000_000
"""Line or document ids up to this number, 16 to 32 MB, are broadcast; more are joined by a shuffle."""


def sent(df: DataFrame, most: int = SENT_WHOLE) -> DataFrame:
    """df, of a few numbers a row, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def _spaced(text: Column) -> Column:
    """text with its other ASCII white space, but for line breaks, as spaces."""
    other = [F.contains(text, F.lit(c)) for c in "\t\x0b\f\r"]
    return F.when(other[0] | other[1] | other[2] | other[3], F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)


def _numbered(docs: DataFrame) -> DataFrame:
    """(d, version, text): version tells the texts apart that rows of one doc_id have; white space within lines is spaces."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.where("text IS NOT NULL").select(d.alias("d"), F.xxhash64("text").alias("version"), _spaced(F.col("text")).alias("text"))


def _sets(numbered: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(d, version, at, row, hashes): the set of every line of numbered texts, or of those wanted(d, at), as hashes in ascending order.

    The number of the row also keeps filters above from computing the set twice.
    """
    lines = numbered.select("d", "version", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.join(wanted, ["d", "at"], "left_semi") if wanted is not None else lines
    hashes = F.sort_array(F.array_distinct(F.transform(F.split(F.lower("line"), " "), lambda w: F.xxhash64(w))))
    return lines.select("d", "version", "at", F.monotonically_increasing_id().alias("row"), F.array_remove(hashes, F.xxhash64(F.lit(""))).alias("hashes"))


def _rarity(numbered: DataFrame) -> Column:
    """How common the words of each bucket are, 0 to 126, in steps of a quarter of a power of two."""
    word = F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " "))
    buckets = numbered.select(word.alias("word")).select(F.xxhash64("word").bitwiseAND(BUCKETS - 1).alias("bucket"))
    steps = ["0"] * BUCKETS
    for row in buckets.groupBy("bucket").count().collect():  # BUCKETS rows at most
        steps[row["bucket"]] = str(min(126, int(4 * math.log2(row["count"] + 1))))
    return F.split(F.lit(" ".join(steps)), " ").cast("array<tinyint>")


def _described(docs: DataFrame, least: int) -> DataFrame:
    """(d, version, at, row, n, k0, k1, b0, b1, picked, prefix) of every line of `least` words; row tells rows apart."""
    numbered = _numbered(docs)
    rarity = _rarity(numbered)
    negative = (F.array_position(F.sort_array(F.array_append("hashes", F.lit(0).cast("long"))), F.lit(0).cast("long")) - 1).cast("int")
    sized = _sets(numbered).withColumn("n", F.size("hashes")).where(F.col("n") >= least).withColumn("negative", negative)

    def odd(hashes: Column, kind: str, bits: int) -> Column:
        """Whether an odd number of these words fall on each bit."""
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast(kind), h.bitwiseAND(bits - 1).cast("int"))
        return F.aggregate(hashes, F.lit(0).cast(kind), lambda so_far, h: so_far.bitwiseXOR(bit(h)))

    # Words whose hashes are negative, which come first, have 64 bits, and the others 32.
    b0 = odd(F.slice("hashes", F.lit(1), F.col("negative")), "long", 64)
    b1 = odd(F.slice("hashes", F.col("negative") + 1, F.col("n") - F.col("negative")), "int", 32)
    # coalesce: arrays that can't hold nulls are sorted as plain numbers.
    rare = lambda h: F.coalesce(F.get(rarity, h.bitwiseAND(BUCKETS - 1).cast("int")).cast("long"), F.lit(0).cast("long"))
    code = F.transform("hashes", lambda h: F.shiftleft(rare(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))
    none = F.array().cast("array<long>")
    large = F.col("n") >= SMALL
    return sized.select(
        "d", "version", "at", "row", "n", F.xxhash64("hashes").alias("k0"), F.xxhash64(F.lit(7), "hashes").alias("k1"), b0.alias("b0"), b1.alias("b1"),
        F.when(large, F.slice("hashes", 1, PICKED)).otherwise(none).alias("picked"), F.when(large, F.slice(F.sort_array(code), F.lit(1), _reach(F.col("n")))).otherwise(none).alias("prefix"),
    )


def _reach(n: Column) -> Column:
    """Words that a line of n words must index, so that similar lines share one."""
    return (n - F.floor((n * PERCENT + 99) / 100) + 1).cast("int")


def _enough(shared: Column, n: Column, m: Column) -> Column:
    """Whether lines of n and m words that share so many are similar."""
    return (100 + PERCENT) * shared >= PERCENT * (n + m)


def _length(a: str) -> Column:
    return F.shiftrightunsigned(F.col(f"{a}.packed"), 32)


def _possible(a: str, b: str, n: Column, m: Column) -> Column:
    """Whether the sketches of two lines, and their lengths n and m, allow the similarity."""
    # An int becomes a long: the bits that its sign fills don't count.
    alone = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}")).cast("long").bitwiseAND(F.lit(ones).cast("long"))) for k, ones in (("b0", -1), ("b1", 2**32 - 1))), F.lit(0))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * alone <= (100 - PERCENT) * (n + m))


def _earlier(a: str, b: str) -> Column:
    return (F.col(f"{a}.d") < F.col(f"{b}.d")) | ((F.col(f"{a}.d") == F.col(f"{b}.d")) & (F.col(f"{a}.at") < F.col(f"{b}.at")))


def _likely(pairs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs(d, at, d0, at0) whose prefixes allow the similarity: a word of one that the other's prefix passes over is its own."""
    some = lines.join(sent(wanted), ["d", "at"], "left_semi").select("d", "at", "n", "prefix")
    both = pairs.join(some, ["d", "at"]).join(some.toDF("d0", "at0", "n0", "prefix0"), ["d0", "at0"])

    def alone(x: str, y: str) -> Column:
        return F.size(F.array_except(F.filter(x, lambda c: c <= F.element_at(y, -1)), F.col(y)))

    n, m = F.col("n"), F.col("n0")
    return both.where(_enough(n - alone("prefix", "prefix0"), n, m) & _enough(m - alone("prefix0", "prefix"), n, m)).select("d", "at", "d0", "at0").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("d", "at").unionByName(pairs.select(F.col("d0").alias("d"), F.col("at0").alias("at"))).distinct()


def _judged(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(d, version, at, similar): whether the set of the later line of any of its pairs(d, at, d0, at0) is similar; pairs are written and distinct."""
    wanted = written(_ends(pairs))
    some = _numbered(docs).join(sent(written(wanted.select("d").distinct())), "d", "left_semi")
    sets = written(_sets(some, sent(wanted)).drop("row").dropDuplicates(["d", "version", "at"]))
    both = pairs.join(sets, ["d", "at"]).join(sets.select(F.col("d").alias("d0"), F.col("at").alias("at0"), F.col("hashes").alias("hashes0")), ["d0", "at0"])
    similar = _enough(F.size(F.array_intersect("hashes", "hashes0")), F.size("hashes"), F.size("hashes0"))
    judged = written(both.select("d", "version", "at", similar.alias("similar")).groupBy("d", "version", "at").agg(F.bool_or("similar").alias("similar")))
    for table in (wanted, sets):
        dropped(table)
    return judged


def _found(judged: DataFrame) -> DataFrame:
    return judged.where("similar").drop("similar")


def _verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(d, version, at) of the later line of the pairs(d, at, d0, at0, shared), shared words of prefixes, whose sets are similar."""
    met = written(pairs)
    best = written(met.groupBy("d", "at").agg(F.max(F.struct("shared", "d0", "at0")).alias("b")).select("d", "at", "b.d0", "b.at0"))
    judged = _judged(best, docs)
    # A line is open as long as one of its versions is.
    still = written(best.join(sent(judged.where("NOT similar").select("d", "at").distinct()), ["d", "at"], "left_semi"))
    o, m = sent(still).alias("o"), met.alias("m")
    other = (F.col("m.d0") != F.col("o.d0")) | (F.col("m.at0") != F.col("o.at0"))
    rest = written(m.join(o, (F.col("m.d") == F.col("o.d")) & (F.col("m.at") == F.col("o.at")) & other, "left_semi").drop("shared"))
    ends = written(_ends(rest))
    likely = written(_likely(rest, lines, ends))
    found = written(_found(judged).unionByName(_found(_judged(likely, docs))))
    for table in (met, best, judged, still, rest, ends, likely):
        dropped(table)
    return found


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(d, version, at): the lines of docs(doc_id, text), of `least` words or more, that an earlier one repeats."""
    docs = docs.select("doc_id", "text")
    lines = written(_described(docs, least))
    groups = sent(written(lines.groupBy("k0", "k1").agg(F.min(F.struct("d", "at", "row")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")))
    equal = written(lines.join(groups, ["k0", "k1"]).where("first.d <> d OR first.at <> at").select("d", "version", "at"))
    firsts = lines.where(F.col("n") >= SMALL).join(groups, ["k0", "k1"], "left").where("first IS NULL OR first.row = row")

    # 3. Against the first line that shares a picked word.
    picked = firsts.select("d", "at", "n", "b0", "b1", F.explode("picked").alias("key"))
    leaders = written(picked.groupBy("key").agg(F.min(F.struct("d", "at", "n", "b0", "b1")).alias("l"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "l.*"))
    met = picked.alias("y").join(sent(leaders).alias("x"), "key").where(_earlier("x", "y") & _possible("x", "y", F.col("x.n"), F.col("y.n")))
    settled = _found(_judged(written(met.select("y.d", "y.at", F.col("x.d").alias("d0"), F.col("x.at").alias("at0")).distinct()), docs))

    # 4. The others, against all earlier lines that share a word of the prefixes.
    rows = firsts.join(sent(settled).withColumn("settled", F.lit(1)), ["d", "version", "at"], "left")
    opened = F.when(F.col("settled").isNull(), 1).otherwise(0)
    # One number has length, place and whether the line is open, as these rows are most of what is shuffled.
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("place").cast("long"), 1)).bitwiseOR(F.col("open").cast("long"))
    postings = rows.select("d", "at", "n", "b0", "b1", opened.alias("open"), F.posexplode("prefix").alias("place", "word"))
    # Equal words have equal keys; what else has them only adds pairs to verify.
    postings = postings.select("d", "at", "b0", "b1", packed.alias("packed"), F.hash("word").alias("key"))
    x, y = postings.alias("x"), postings.alias("y")
    n, m = _length("x"), _length("y")
    place = lambda a: F.shiftright(F.col(f"{a}.packed").bitwiseAND(2**32 - 1), 1)
    # Words from the shared one on are all that can be shared.
    room = F.least(n - place("x"), m - place("y"))
    # `open` is asked of y alone, in terms of both sides: so both read one exchange.
    near = _enough(room, n, m) & (F.col("y.packed").bitwiseAND(1) * (F.col("x.packed").bitwiseAND(1) + 1) > 0) & _earlier("x", "y") & _possible("x", "y", n, m)
    pairs = y.join(x, (F.col("x.key") == F.col("y.key")) & near).groupBy("y.d", "y.at", F.col("x.d").alias("d0"), F.col("x.at").alias("at0")).agg(F.count(F.lit(1)).alias("shared"))
    return equal.unionByName(settled).unionByName(_verified(pairs, lines, docs)).distinct()


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the lines of text that an earlier line repeats removed, and the number of them in n_removed."""
    # Names of our own can't clash with those of the table.
    d, version, gone, lines = (f"{name}{'_' * max(map(len, docs.columns))}" for name in ("d", "version", "gone", "lines"))
    found = written(repeated_lines(docs, least).groupBy("d", "version").agg(F.collect_list("at").alias("gone")))
    marked = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn(version, F.xxhash64("text"))
    both = marked.join(sent(found.toDF(d, version, gone)), [d, version], "left").withColumn(lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda at: F.get(F.col(lines), at)), "\n"))
    count = F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.col(gone)))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_removed")], kept.alias("text"), count.alias("n_removed"))
