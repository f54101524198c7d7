from pyspark.sql import functions as F

from notewell.functions import inference, temporal, text, urls


def values(spark, rows, make):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("x"))).collect()]


def test_normalised(spark):
    assert values(spark, ["  The `Quick`  BROWN fox!! ", "", "é"], text.normalized) == ["the quick brown fox", "", ""]


def test_similarity(spark):
    rows = [
        ("use jwt tokens for auth", "use jwt tokens for auth", 1.0), ("", "", 1.0), ("", "word", 0.0), ("a b", "c d", 0.55),
        ("always use jwt for api authentication", "always use jwt for the api authentication", None), ("deploy on fridays", "cats like fish", None),
    ]
    frame = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    got = [r[0] for r in frame.select(text.similarity_of(text.normalized(F.col("a")), text.normalized(F.col("b")))).collect()]
    for value, (_, _, wanted) in zip(got, rows, strict=True):
        assert wanted is None or abs(value - wanted) < 1e-12
    assert got[4] > 0.85 and got[5] < 0.4


def test_tags(spark):
    raw = ['["a", "B"]', '["x", 1, null, {"k": 1}]', "broken", '{"a": 1}', "[]", None]
    assert values(spark, raw, text.parsed_tags) == [["a", "B"], ["x"], [], [], [], []]
    merged = spark.range(1).select(text.merged_tags(F.array(F.lit(" A"), F.lit("b")), F.array(F.lit("a "), F.lit(""), F.lit("c")))).first()[0]
    assert merged == ["a", "b", "c"]
    assert spark.range(1).select(text.cleaned_tags(F.array(F.lit(" A"), F.lit("a"), F.lit(" ")))).first()[0] == ["A", "a"]


def test_mentions_stand_alone(spark):
    replaced = values(spark, ["see old-key now", "old-key", "my-old-key", "old-key/sub", "old-key, old-key"], lambda c: text.mention_replaced(c, "old-key", "a/$1"))
    assert replaced == ["see a/$1 now", "a/$1", "my-old-key", "old-key/sub", "a/$1, a/$1"]


def test_types(spark):
    notes = {
        "Fixed the login crash": "bug_fix", "root cause was a race": "bug_fix", "We decided to use postgres": "decision", "chose redis over memcached": "decision",
        "JWT lives in the session cookie": "convention", "see issue #123": "issue", "reviewers prefer small diffs": "reviewer_pattern", "plain": "convention",
        "auth token chosen instead of cookies": "decision", "éfix": "bug_fix", "always; we adopted": "decision",
    }
    got = dict(zip(notes, values(spark, list(notes), inference.inferred_type), strict=True))
    assert {k: v for k, v in got.items() if notes[k] != v} == {}


def test_inferred_tags(spark):
    tags = values(spark, ["Fix the /api/auth_v2 bug in vite.config.ts for login"], inference.inferred_tags)[0]
    assert 2 <= len(tags) <= 5 and len(set(tags)) == len(tags) and "api" in tags and all(t == t.lower() for t in tags)


def test_dates(spark):
    day = F.to_date(F.lit("2026-06-26"))
    found = values(spark, ["yesterday, today and tomorrow", "last week or next week", "3 days ago, 2 weeks ago", "in 10 days, in 2 months", "soon"], lambda c: temporal.resolved_dates(c, day))
    assert [[r["date"][5:] for r in x] for x in found] == [["06-25", "06-26", "06-27"], ["06-19", "07-03"], ["06-23", "06-12"], ["07-06", "08-26"], []]
    assert values(spark, ["last month"], lambda c: temporal.resolved_dates(c, F.to_date(F.lit("2026-03-31"))))[0][0]["date"] == "2026-03-03"
    once = values(spark, ["done last week", "nothing"], lambda c: temporal.grounded(c, day))
    assert once == ["done last week (last week = 2026-06-19)", "nothing"]
    assert values(spark, once, lambda c: temporal.grounded(c, day)) == once


def test_remotes(spark):
    addresses = ["git@h.example:own/name.git", "https://h.example/own/name", "https://h.example/a/b/c.git", "ssh://git@h.example/own/name.git", " ", "junk"]
    assert values(spark, addresses, urls.remote_key) == ["own/name", "own/name", "a/b/c", "own/name", None, None]


def test_changelog(spark):
    entry = F.array(text.change(at=F.lit(1), action=F.lit("x")))
    raw = ["{}", '{"changelog":[{"at":0,"action":"y"}]}', "broken", '{"k":{"z":1}}']
    made = values(spark, raw, lambda c: text.with_changes(c, entry))
    assert made[0] == made[2] == '{"changelog":[{"at":1,"action":"x"}]}'
    assert made[1] == '{"changelog":[{"at":0,"action":"y"},{"at":1,"action":"x"}]}'
    assert made[3] == '{"k":{"z":1},"changelog":[{"at":1,"action":"x"}]}'
