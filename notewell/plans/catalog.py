"""Every query of the library on the test tables, with its oracle for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.functions import inference, temporal, text, urls
from notewell.operators import context, dedupe, fts, keys, memory, reports, search, vectors
from notewell.plans import fixtures as fx
from notewell.plans import oracles as sql
from notewell.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS, ONE_WORD = "the and", "onher"
MANY_WORDS = "ouen retitioning nowhere"
PHRASE = "of/the"
QUERY_ROWS = [(1, WORDS, None), (2, MANY_WORDS, None), (3, "of-the", "corpus/en"), (4, "zzz qqq", "corpus/de"), (5, "en", "corpus/en"), (6, "(nothing) zzz", None)]
QUERY_PHRASES = {1: ["the", "and"], 2: ["ouen", "retitioning", "nowhere"], 3: ["of", "the"], 4: ["zzz", "qqq"], 5: ["en"], 6: ["nothing", "zzz"]}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


def _memories(spark, d):
    return fx.memories(spark, d)


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_ROWS, "query_id int, query string, repo string")


ASKED_SQL = "asked(query_id, query, repo) AS (VALUES " + ", ".join(f"({i}, {sql.quoted(q)}, {'NULL' if r is None else sql.quoted(r)})" for i, q, r in QUERY_ROWS) + ")"

# Scalar functions and projections


@query(f"SELECT doc_id, {fx.norm_sql('text')} AS note_normalized FROM documents")
def normalize_note(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.normalized(F.col("text")).alias("note_normalized"))


@query(_with(fx.MEMORIES_SQL, "SELECT row_id, id, repo, type, note, tags, created_at, updated_at, pinned FROM memories WHERE repo = 'corpus/fr'"))
def repo_scan(spark, d):
    return _memories(spark, d).where("repo = 'corpus/fr'").select("row_id", "id", "repo", "type", "note", "tags", "created_at", "updated_at", "pinned")


_RAW_TAGS = ['["a","B "," a"]', '["x",1,null,{"y":2},"z"]', "not json", '{"a":1}', '"s"', "[]", '[" ","ok"]', "7"]


@query("SELECT * FROM (VALUES (0, 'a|B | a'), (1, 'x|z'), (2, ''), (3, ''), (4, ''), (5, ''), (6, ' |ok'), (7, '')) t(n, parsed)")
def parse_tags(spark, d):
    rows = spark.createDataFrame(list(enumerate(_RAW_TAGS)), "n int, tags string")
    return rows.select("n", F.array_join(text.parsed_tags(F.col("tags")), "|").alias("parsed"))


@query(_with(fx.MEMORIES_SQL, f"SELECT row_id, array_to_string({sql.first_of('list_concat([split_part(tags, chr(34), 2), split_part(tags, chr(34), 4)], [upper(split_part(tags, chr(34), 2)), type])').replace('upper(', 'lower(')}, '|') AS merged FROM memories"))
def merge_tags(spark, d):
    own = text.parsed_tags(F.col("tags"))
    return _memories(spark, d).select("row_id", F.array_join(text.merged_tags(own, F.array(F.concat(F.lit(" "), F.upper(own[0])), F.col("type"), F.lit(" "))), "|").alias("merged"))


@query("SELECT * FROM (VALUES (0, '{\"changelog\":[{\"at\":5,\"action\":\"x\"}]}'), (1, '{\"changelog\":[{\"at\":1,\"action\":\"created\"},{\"at\":5,\"action\":\"x\"}]}'), (2, '{\"other\":{\"k\":[1]},\"changelog\":[{\"at\":5,\"action\":\"x\"}]}'), (3, '{\"changelog\":[{\"at\":5,\"action\":\"x\"}]}'), (4, '{\"changelog\":[{\"at\":5,\"action\":\"x\"}]}')) t(n, metadata)")
def append_changelog(spark, d):
    raw = ["{}", '{"changelog":[{"at":1,"action":"created"}]}', '{"other":{"k":[1]}}', "broken", "[1]"]
    entry = text.change(at=F.lit(5), action=F.lit("x"))
    return spark.createDataFrame(list(enumerate(raw)), "n int, m string").select("n", text.with_changes(F.col("m"), F.array(entry)).alias("metadata"))


@query(_with(fx.phrased_sql(fx.CUED), f"SELECT row_id, {sql.type_sql('note')} AS type FROM phrased"))
def infer_type(spark, d):
    return fx.phrased(spark, d, fx.CUED).select("row_id", inference.inferred_type(F.col("note")).alias("type"))


@query(_with(fx.phrased_sql(fx.CUED), f"SELECT row_id, array_to_string({sql.keyword_tags('note')}, '|') AS tags FROM phrased"))
def keyword_tags(spark, d):
    return fx.phrased(spark, d, fx.CUED).select("row_id", F.array_join(inference.keyword_tags(F.col("note")), "|").alias("tags"))


@query(_with(fx.phrased_sql(fx.CUED), f"SELECT row_id, array_to_string({sql.identifier_tags('note')}, '|') AS tags FROM phrased"))
def identifier_tags(spark, d):
    return fx.phrased(spark, d, fx.CUED).select("row_id", F.array_join(inference.identifier_tags(F.col("note")), "|").alias("tags"))


@query(_with(fx.phrased_sql(fx.CUED), sql.salient_words("phrased"), "SELECT row_id, array_to_string(words, '|') AS words FROM salient"))
def salient_words(spark, d):
    return fx.phrased(spark, d, fx.CUED).select("row_id", F.array_join(inference.salient_words(F.col("note")), "|").alias("words"))


_ALL_TAGS = f"list_concat({sql.keyword_tags('note')}, list_concat({sql.identifier_tags('note')}, words))"


@query(_with(fx.phrased_sql(fx.CUED), sql.salient_words("phrased"), f"t AS (SELECT row_id, {_ALL_TAGS} AS a FROM phrased JOIN salient USING (row_id))", f"SELECT row_id, array_to_string(list_slice({sql.first_of('a')}, 1, 5), '|') AS tags FROM t"))
def infer_tags(spark, d):
    return fx.phrased(spark, d, fx.CUED).select("row_id", F.array_join(inference.inferred_tags(F.col("note")), "|").alias("tags"))


@query(_with(fx.phrased_sql(fx.DATED), f"SELECT row_id, array_to_string({sql.dates_sql('note', fx.DAY)}, '|') AS dates FROM phrased"))
def resolve_dates(spark, d):
    found = temporal.resolved_dates(F.col("note"), F.to_date(F.lit(fx.DAY)))
    return fx.phrased(spark, d, fx.DATED).select("row_id", F.array_join(F.transform(found, lambda p: F.concat_ws(" = ", p["phrase"], p["date"])), "|").alias("dates"))


@query(_with(fx.phrased_sql(fx.DATED), f"t AS (SELECT row_id, note, list_filter({sql.dates_sql('note', '2026-03-31')}, lambda x: NOT contains(note, x)) AS p FROM phrased)", "SELECT row_id, CASE WHEN len(p) > 0 THEN note || ' (' || array_to_string(p, '; ') || ')' ELSE note END AS note FROM t"))
def ground_dates(spark, d):
    return fx.phrased(spark, d, fx.DATED).select("row_id", temporal.grounded(F.col("note"), F.to_date(F.lit("2026-03-31"))).alias("note"))


_URLS = ["git@host.example:own/name.git", "ssh://git@host.example/own/name.git", "git://host.example/group/sub/name", "ssh://u@h:22/a/b", "  ", "junk", "https://u:p@host.example/own/name.git/"]
_REMOTE_SQL = "coalesce(" + ", ".join(
    rf"nullif(regexp_replace(regexp_replace(replace(regexp_replace(regexp_extract(trim(url), '{p}', 2), '^/+', ''), '\', '/'), '(?i)\.git$', ''), '/+$', ''), '')" for p in urls.REMOTES
) + ")"


@query(f"WITH remotes AS (SELECT page_id AS n, url FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f'({-1 - i}, {sql.quoted(u)})' for i, u in enumerate(_URLS))}) t(n, url)) SELECT n, {_REMOTE_SQL} AS key FROM remotes")
def normalize_remote(spark, d):
    own = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(_URLS)], "n long, url string")
    rows = fx.table(spark, d, "pages").select(F.col("page_id").alias("n"), "url").unionByName(own)
    return rows.select("n", urls.remote_key(F.col("url")).alias("key"))


# Rankings and context

_TOP = "row_number() OVER (PARTITION BY repo ORDER BY {order})"
_PINNED = f"SELECT *, {_TOP.format(order='updated_at DESC, row_id')} AS place FROM memories WHERE pinned = 1"
_RECENT = f"SELECT *, {_TOP.format(order='updated_at DESC, row_id')} AS place FROM memories WHERE pinned = 0"
_REPORT = f"SELECT *, {_TOP.format(order='pinned DESC, updated_at DESC, row_id')} AS place FROM memories"


@query(_with(fx.MEMORIES_SQL, f"SELECT repo, place, row_id FROM ({_PINNED}) WHERE place <= 3"))
def repo_pinned_topk(spark, d):
    return context.newest(_memories(spark, d), 1, 3).select("repo", "place", "row_id")


@query(_with(fx.MEMORIES_SQL, f"SELECT repo, place, row_id FROM ({_RECENT}) WHERE place <= 8"))
def repo_recent_topk(spark, d):
    return context.newest(_memories(spark, d), 0, 8).select("repo", "place", "row_id")


@query(_with(fx.MEMORIES_SQL, f"SELECT repo, place, row_id FROM ({_REPORT}) WHERE place <= 10"))
def repo_report_topk(spark, d):
    return context.report_rows(_memories(spark, d), 10).select("repo", "place", "row_id")


def _context_sql(limit: int, matched: str | None = None) -> str:
    """context(repo, place, row_id, source, rank) and all columns of memories."""
    lists = f"SELECT *, 0 AS part, NULL::DOUBLE AS rank FROM ({_PINNED}) WHERE place <= {limit} UNION ALL BY NAME SELECT *, 2 AS part, NULL::DOUBLE AS rank FROM ({_RECENT}) WHERE place <= {limit}"
    if matched:
        lists += f" UNION ALL BY NAME SELECT m.*, x.place, 1 AS part, x.rank FROM ({matched}) x JOIN memories m USING (row_id) WHERE m.repo NOT IN (SELECT repo FROM memories WHERE pinned = 1 GROUP BY repo HAVING count(*) >= {limit})"
    return f"""lists AS ({lists}),
 once AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY part, place) = 1),
 texts AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY repo, CASE WHEN note_normalized = '' THEN '#' || row_id ELSE note_normalized END ORDER BY part, place) = 1),
 context AS (SELECT * EXCLUDE (place, part), ['pinned', 'search', 'recent'][part + 1] AS source, row_number() OVER (PARTITION BY repo ORDER BY part, place) AS place FROM texts QUALIFY place <= {limit})"""


@query(_with(fx.MEMORIES_SQL, _context_sql(8).replace("AS place FROM texts QUALIFY place <= 8", "AS spot FROM texts QUALIFY spot <= 8"), "SELECT repo, spot AS place, row_id, source FROM context"))
def context_no_query(spark, d):
    return context.assembled(_memories(spark, d), 8).select("repo", "place", "row_id", "source")


def _spot(limit: int, matched: str | None = None) -> str:
    return _context_sql(limit, matched).replace(f"AS place FROM texts QUALIFY place <= {limit}", f"AS spot FROM texts QUALIFY spot <= {limit}")


_KEYWORDS = f"SELECT m.repo, row_id, rank, row_number() OVER (PARTITION BY m.repo ORDER BY rank, row_id) AS place FROM found JOIN memories m USING (row_id) WHERE matched = asked QUALIFY place <= {{limit}}"


@query(_with(fx.MEMORIES_SQL, sql.fts({0: ["of the", "and"]}), _spot(8, _KEYWORDS.format(limit=8)), "SELECT repo, spot AS place, row_id, source, round(rank, 6) AS rank FROM context"))
def context_with_query(spark, d):
    rows = _memories(spark, d)
    return context.assembled(rows, 8, context.keyword_list(rows, f"{PHRASE} and", 8)).select("repo", "place", "row_id", "source", F.round("rank", 6).alias("rank"))


_COSINE = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NEAR = f"""near AS (SELECT q.vec_id AS query_id, m.repo, m.row_id, {_COSINE.format(a='v.vector', b='q.embedding')} AS score FROM vectors v JOIN memories m ON m.row_id = v.memory_rowid, (SELECT vec_id, embedding FROM embeddings WHERE {{which}}) q),
 knn AS (SELECT *, row_number() OVER (PARTITION BY query_id, repo ORDER BY score DESC, row_id) AS place FROM near WHERE score > 0)"""
_EVERY, _ZERO = _NEAR.format(which="vec_id % 100 = 0"), _NEAR.format(which="vec_id = 0")


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, _EVERY, "SELECT query_id, repo, row_id, place, round(score, 6) AS score FROM knn WHERE place <= 10"))
def vector_knn(spark, d):
    found = vectors.neighbours(fx.query_vector(spark, d), _memories(spark, d), fx.vectors(spark, d), 64, 1000, 10)
    return found.select("query_id", "repo", "row_id", "place", F.round("score", 6).alias("score"))


_FUSED = """fused AS (SELECT query_id, repo, row_id, rank, row_number() OVER (PARTITION BY query_id, repo ORDER BY score DESC, first, row_id) AS place FROM
 (SELECT query_id, repo, row_id, max(rank) AS rank, sum(1.0::DOUBLE / (60 + place)) AS score, min(list * 1000 + place) AS first FROM
 (SELECT query_id, repo, row_id, place, rank, 0 AS list FROM kw, asked UNION ALL SELECT query_id, repo, row_id, place, NULL, 1 FROM knn WHERE place <= 8) GROUP BY ALL) QUALIFY place <= 8)"""


def _each_context(limit: int) -> str:
    """contexts(query_id, repo, spot, row_id, source, rank) of the lists in fused, one for each query and repo."""
    return f"""lists AS (SELECT query_id, repo, row_id, place, 0 AS part, NULL::DOUBLE AS rank FROM ({_PINNED}), asked WHERE place <= {limit} UNION ALL SELECT query_id, repo, row_id, place, 2, NULL FROM ({_RECENT}), asked WHERE place <= {limit}
   UNION ALL SELECT query_id, repo, row_id, place, 1, rank FROM fused WHERE repo NOT IN (SELECT repo FROM memories WHERE pinned = 1 GROUP BY repo HAVING count(*) >= {limit})),
 once AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, row_id ORDER BY part, place) = 1),
 texts AS (SELECT o.*, note_normalized FROM once o JOIN memories USING (row_id) QUALIFY row_number() OVER (PARTITION BY query_id, o.repo, CASE WHEN note_normalized = '' THEN '#' || row_id ELSE note_normalized END ORDER BY part, place) = 1),
 contexts AS (SELECT query_id, repo, row_id, rank, ['pinned', 'search', 'recent'][part + 1] AS source, row_number() OVER (PARTITION BY query_id, repo ORDER BY part, place) AS spot FROM texts QUALIFY spot <= {limit})"""


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, sql.fts({0: ["of the", "and"]}).replace("asked", "wanted"), f"kw AS ({_KEYWORDS.format(limit=8).replace('asked', 'wanted')})", "asked AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0)", _EVERY, _FUSED, _each_context(8), "SELECT query_id, repo, spot AS place, row_id, source, round(rank, 6) AS rank FROM contexts"))
def context_hybrid_rrf(spark, d):
    """Each query has a context of its own in each repo: a key of both stands for the repo."""
    rows, asked = _memories(spark, d), fx.query_vector(spark, d)
    key = F.struct("query_id", "repo").alias("repo")

    def each(found: DataFrame) -> DataFrame:
        return found.crossJoin(F.broadcast(asked.select("query_id"))).select(key, *[c for c in found.columns if c != "repo"])

    near = vectors.neighbours(asked, rows, fx.vectors(spark, d), 64, 1000, 8)
    both = written(context.fused(each(context.keyword_list(rows, f"{PHRASE} and", 8)), near.withColumn("repo", key), 8))
    # Only rows that some list has are dealt to the queries.
    listed = context.newest(rows, 1, 8).select("row_id").unionByName(context.newest(rows, 0, 8).select("row_id")).unionByName(both.select("row_id"))
    found = context.assembled(each(written(rows.join(listed.distinct(), "row_id", "left_semi"))), 8, both)
    return found.select("repo.query_id", "repo.repo", "place", "row_id", "source", F.round("rank", 6).alias("rank"))


# Keyword search


@query(r"""SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(text), '["()]', ' ', 'g'), '[\s/_\-.,;:!?]+'), lambda w: regexp_replace(w, '[^a-z0-9*]', '', 'g')), lambda w: length(w) >= 2), ' ') AS words FROM benchmark""")
def fts_tokenize(spark, d):
    return fx.table(spark, d, "benchmark").select("item_id", F.array_join(fts.query_words(F.col("text")), " ").alias("words"))


@query(_with(fx.MEMORIES_SQL, f"SELECT row_id, term, count(*) AS n FROM (SELECT row_id, unnest({sql.terms('repo || chr(32) || note')}) AS term FROM memories) GROUP BY ALL"))
def fts_postings(spark, d):
    return fts.postings(_memories(spark, d)).groupBy("row_id", "term").agg(F.sum(F.size("places")).alias("n"))


_FOUND = "SELECT query_id, row_id, matched, round(rank, 6) AS rank FROM found"


def _search(spark, d, level):
    found = fts.matches(_asked(spark), fts.query_words(F.col("query")), _memories(spark, d))
    return found.where(level).select("query_id", "row_id", "matched", F.round("rank", 6).alias("rank"))


@query(_with(fx.MEMORIES_SQL, sql.fts(QUERY_PHRASES), f"{_FOUND} WHERE matched = asked"))
def fts_and_search(spark, d):
    return _search(spark, d, "matched = asked")


@query(_with(fx.MEMORIES_SQL, sql.fts(QUERY_PHRASES), _FOUND))
def fts_or_search(spark, d):
    return _search(spark, d, "matched > 0")


@query(_with(fx.MEMORIES_SQL, sql.fts({0: ["of the"], 1: ["corpus en", "the and"], 2: ["", "the"]}), _FOUND))
def fts_phrase_search(spark, d):
    asked = spark.createDataFrame([(0, "of/the"), (1, "corpus/en the-and"), (2, "--- the")], "query_id int, query string")
    found = fts.matches(asked, fts.quoted_words(F.col("query")), _memories(spark, d))
    return found.select("query_id", "row_id", "matched", F.round("rank", 6).alias("rank"))


_CASCADE = f"""scoped AS (SELECT f.*, a.repo AS wanted FROM found f JOIN asked a USING (query_id) JOIN memories m USING (row_id) WHERE a.repo IS NULL OR a.repo = m.repo),
 levels AS (SELECT query_id, row_id, 1 AS level, rank FROM scoped WHERE matched = asked UNION ALL SELECT query_id, row_id, 2, rank FROM scoped WHERE asked > 1),
 placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY rank, row_id) AS place FROM levels QUALIFY place <= 5
   UNION ALL SELECT a.query_id, k.row_id, 3, k.score, k.place FROM asked a JOIN knn k ON k.repo = a.repo WHERE place <= 5 AND a.query_id <> 4
   UNION ALL SELECT query_id, c.row_id, 4, 0.0, c.spot FROM asked a JOIN context c ON c.repo = a.repo),
 best AS (SELECT p.* FROM placed p JOIN (SELECT query_id, min(level) AS level FROM placed GROUP BY 1) USING (query_id, level))"""


def _cascade(spark, d):
    rows, asked = _memories(spark, d), _asked(spark)
    near = vectors.neighbours(fx.query_vector(spark, d).where("query_id = 0"), rows, fx.vectors(spark, d), 64, 1000, 5).drop("query_id")
    near = near.join(asked.where("repo IS NOT NULL AND query_id <> 4").select("query_id", "repo"), "repo")
    return search.cascade(asked, rows, 5, near), rows, asked


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, ASKED_SQL, sql.fts(QUERY_PHRASES), _ZERO, _spot(5), _CASCADE, "SELECT query_id, row_id, level, round(rank, 6) AS rank, place FROM best"))
def search_cascade(spark, d):
    return _cascade(spark, d)[0].select("query_id", "row_id", "level", F.round("rank", 6).alias("rank"), "place")


_TAGS = "split_part(tags, chr(34), 2) || ', ' || split_part(tags, chr(34), 4)"
_PIN = f"CASE WHEN pinned = 1 THEN '{reports.PIN}Pinned ' ELSE '' END"


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, ASKED_SQL, sql.fts(QUERY_PHRASES), _ZERO, _spot(5), _CASCADE, f"""
 lists AS (SELECT query_id, any_value(level) AS level, string_agg(place || '. [' || repo || '] ' || type || ' (' || row_id || ' | legacy: ' || id || ')' || chr(10) || {_PIN} || note || ' | tags: ' || {_TAGS}, chr(10) || chr(10) ORDER BY place) AS lines FROM best JOIN memories USING (row_id) GROUP BY 1),
 said AS (SELECT query_id, level, lines, '"' || query || '"' || CASE WHEN repo IS NULL THEN '' ELSE ' in ' || repo END AS q FROM asked LEFT JOIN lists USING (query_id))
""".replace("lists AS", "shown AS").replace("LEFT JOIN lists", "LEFT JOIN shown"), """SELECT query_id, CASE WHEN lines IS NULL THEN 'No memories matched ' || q || '.' WHEN level = 4 THEN 'No exact match for ' || q || '; showing recent + pinned context:' || chr(10) || chr(10) || lines
 ELSE 'Search results for ' || q || ':' || chr(10) || chr(10) || lines END AS report FROM said"""))
def search_report(spark, d):
    found, rows, asked = _cascade(spark, d)
    return reports.search_text(found, rows, asked)


# Vectors


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, "SELECT row_id FROM memories WHERE row_id NOT IN (SELECT memory_rowid FROM vectors WHERE dim = 64 AND version = 1000)"))
def vector_backfill_missing(spark, d):
    return vectors.missing(_memories(spark, d), fx.vectors(spark, d), 64, 1000).select("row_id")


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, "SELECT (SELECT count(*) FROM memories WHERE row_id NOT IN (SELECT memory_rowid FROM vectors)) + (SELECT count(*) FROM vectors) AS n_vectors, (SELECT count(*) FROM memories WHERE row_id NOT IN (SELECT memory_rowid FROM vectors)) AS n_made"))
def vector_backfill(spark, d):
    rows, held = _memories(spark, d).select("row_id", "note", "repo"), fx.vectors(spark, d)
    full = vectors.backfilled(rows, held, F.lit(fx.NOW), version=1000, dim=64)
    return full.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_if(F.col("updated_at") == fx.NOW).alias("n_made"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(_with(fx.MEMORIES_SQL, f"words AS (SELECT row_id, {sql.tokens('note_normalized')} AS w FROM memories)",
 "features AS (SELECT row_id, unnest(w) AS f, 1.0::DOUBLE AS weight FROM words UNION ALL SELECT row_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 0.6::DOUBLE FROM words)",
 "summed AS (SELECT row_id, f, sum(weight) AS weight FROM features GROUP BY ALL)",
 f"known AS (SELECT f, ({_FNV.format(x='f')} % 256)::INT AS bucket, CASE WHEN {_FNV.format(x=chr(39) + '#' + chr(39) + ' || f')} % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM (SELECT DISTINCT f FROM summed))",
 "raw AS (SELECT row_id, bucket, sum(sign * weight) AS v FROM summed JOIN known USING (f) GROUP BY ALL)",
 "SELECT row_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY row_id)), 5) + 0.0 AS value FROM raw QUALIFY abs(v) > 1e-9"))
def hashed_embedding(spark, d):
    found = vectors.hashed(_memories(spark, d).select("row_id", "note"))
    return found.where(F.abs("value") > 1e-12).select("row_id", "bucket", (F.round("value", 5) + 0.0).alias("value"))


def _toy_embedder(texts: list[str]) -> list:
    """Counts of eight letters: an external embedder for tests. Texts on "the" first fail."""
    return [None if t.startswith("The") else [float(t.count(c)) for c in "etaoinsr"] for t in texts]


@query()
def external_embed(spark, d):
    made = vectors.embedded(_memories(spark, d).select("row_id", "note"), _toy_embedder, 8)
    return made.select("row_id", "dim", "version", F.round(vectors.dot(F.col("vector"), F.col("vector")), 3).alias("norm"))


# Duplicates and related notes

_CANDIDATES = "candidates AS (SELECT row_id, repo, type, note, note_normalized, updated_at, row_number() OVER (PARTITION BY repo ORDER BY updated_at DESC, row_id) AS place FROM memories QUALIFY place <= 200)"


def _compared(probes: str) -> tuple[str, ...]:
    return (fx.MEMORIES_SQL, probes, _CANDIDATES, sql.prepared("pp", "probes", fx.norm_sql("note")), sql.prepared("cc", "candidates", "note_normalized"),
            f"compared AS (SELECT pp.probe_id, pp.repo, pp.note AS probe, cc.row_id, cc.note, cc.place, {sql.similarity('pp', 'cc')} AS similarity FROM pp JOIN cc ON pp.repo = cc.repo WHERE pp.n <> '')")


@query(_with(*_compared(fx.PROBES_SQL), "SELECT probe_id, row_id, place, round(similarity, 6) AS similarity FROM compared"))
def pair_similarity(spark, d):
    return dedupe.compared(fx.probes(spark, d), _memories(spark, d)).select("probe_id", "row_id", "place", F.round("similarity", 6).alias("similarity"))


_OWN_PROBES = "probes AS (SELECT id AS probe_id, repo, note || ' indeed' AS note FROM memories UNION ALL SELECT id || ':upper', repo, upper(note) FROM memories)"


def _own_probes(spark, d):
    """Every note twice: with a word more, and in capitals."""
    rows = _memories(spark, d)
    capitals = rows.select(F.concat("id", F.lit(":upper")).alias("probe_id"), "repo", F.upper("note").alias("note"))
    return fx.own_probes(spark, d).unionByName(capitals)


_DUPLICATES = f"""exact AS (SELECT p.probe_id, m.row_id, 1.0::DOUBLE AS similarity FROM (SELECT *, {fx.norm_sql('note')} AS n FROM probes) p JOIN memories m ON m.repo = p.repo AND m.note_normalized = p.n WHERE p.n <> ''
   QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY updated_at DESC, row_id) = 1),
 words_ AS (SELECT probe_id, cc.row_id, place, pp.n AS pn, cc.n AS cn, {sql.jaccard('pp.w', 'cc.w')} AS of_words FROM pp JOIN cc ON pp.repo = cc.repo WHERE pp.n <> '' AND probe_id NOT IN (SELECT probe_id FROM exact) AND least(len(pp.w), len(cc.w)) >= 0.67 * greatest(len(pp.w), len(cc.w))),
 grams AS (SELECT probe_id, row_id, place, of_words, {sql.trigrams('pn')} AS pg, {sql.trigrams('cn')} AS cg FROM words_ WHERE of_words >= 0.67),
 near_ AS (SELECT probe_id, row_id, 0.55::DOUBLE * of_words + 0.45::DOUBLE * ({sql.jaccard('pg', 'cg')}) AS similarity FROM grams WHERE similarity >= 0.82 QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, place) = 1),
 dups AS (SELECT * FROM exact UNION ALL SELECT * FROM near_ WHERE probe_id NOT IN (SELECT probe_id FROM exact))"""


# Words alone must be alike by 0.67 for a similarity of 0.82; only then are trigrams made.
@query(_with(fx.MEMORIES_SQL, _OWN_PROBES, _CANDIDATES, f"pp AS (SELECT *, list_distinct({sql.tokens('n')}) AS w FROM (SELECT *, {fx.norm_sql('note')} AS n FROM probes))", f"cc AS (SELECT *, list_distinct({sql.tokens('n')}) AS w FROM (SELECT *, note_normalized AS n FROM candidates))", _DUPLICATES, "SELECT probe_id, row_id, round(similarity, 6) AS similarity FROM dups"))
def find_duplicate(spark, d):
    return dedupe.duplicates(_own_probes(spark, d), _memories(spark, d)).select("probe_id", "row_id", F.round("similarity", 6).alias("similarity"))


_RELATED = f"""related AS (SELECT probe_id, row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, place) AS n, row_id, similarity, probe, note,
 ({sql.says('probe', sql.rules.CONTRADICTION)}) <> ({sql.says('note', sql.rules.CONTRADICTION)}) AS flag FROM compared WHERE similarity >= 0.15 AND similarity < 0.82 QUALIFY n <= 3)"""


@query(_with(*_compared(fx.PROBES_SQL), _RELATED, "SELECT probe_id, n AS place, row_id, round(similarity, 6) AS similarity, flag AS possible_contradiction FROM related"))
def find_related(spark, d):
    found = dedupe.related(fx.probes(spark, d), _memories(spark, d), floor=0.15)
    return found.withColumn("similarity", F.round("similarity", 6))


_NOTICE = """noted AS (SELECT probe_id, string_agg('  - #' || row_id || ' (similarity ' || printf('%.2f', similarity) || ')' || CASE WHEN flag THEN ' ⚠ may contradict/supersede' ELSE '' END || ': ' ||
   CASE WHEN length(note) > 100 THEN substr(note, 1, 97) || '...' ELSE note END, chr(10) ORDER BY n) AS lines, bool_or(flag) AS any_ FROM related GROUP BY probe_id)"""
_RECONCILE = """SELECT probe_id, chr(10) || chr(10) || 'Related existing memories you may want to reconcile:' || chr(10) || lines || chr(10) || CASE WHEN any_
 THEN 'If this new note replaces or contradicts any of them, call update_memory to revise the existing memory or delete_memory to remove the stale one. Otherwise no action is needed.'
 ELSE 'If this new note updates any of them, consider update_memory; otherwise keeping both is fine.' END AS notice FROM noted"""


@query(_with(*_compared(fx.PROBES_SQL), _RELATED, _NOTICE, _RECONCILE))
def conflict_notice(spark, d):
    rows = _memories(spark, d)
    return reports.conflict_notice(dedupe.related(fx.probes(spark, d), rows, floor=0.15), rows)


_EDGES = (
    sql.prepared("mm", "memories", "note_normalized"),
    "met AS (SELECT DISTINCT a.row_id AS x, b.row_id AS y FROM (SELECT row_id, repo, type, len(w) AS k, unnest(w) AS t FROM mm) a JOIN (SELECT row_id, repo, type, len(w) AS k, unnest(w) AS t FROM mm) b USING (repo, type, t) WHERE a.row_id < b.row_id AND least(a.k, b.k) >= 0.7 * greatest(a.k, b.k))",
    f"""edges AS (SELECT p.repo, p.type, CASE WHEN p.updated_at > q.updated_at THEN x ELSE y END AS newer, CASE WHEN p.updated_at > q.updated_at THEN y ELSE x END AS older, {sql.similarity('p', 'q')} AS similarity
 FROM met JOIN mm p ON p.row_id = x JOIN mm q ON q.row_id = y WHERE len(list_intersect(p.w, q.w)) >= 0.4 * (len(p.w) + len(q.w)) AND {sql.similarity('p', 'q')} >= 0.85)""",
)


@query(_with(fx.MEMORIES_SQL, *_EDGES, "SELECT repo, type, newer, older, round(similarity, 6) AS similarity FROM edges"))
def dedupe_edges(spark, d):
    return dedupe.edges(_memories(spark, d)).withColumn("similarity", F.round("similarity", 6))


_PLAN = """ends AS (SELECT DISTINCT row_id, updated_at FROM memories WHERE row_id IN (SELECT newer FROM edges UNION SELECT older FROM edges)),
 ranked AS (SELECT row_id, row_number() OVER (ORDER BY updated_at DESC, row_id) AS k FROM ends),
 newer_of AS (SELECT r.row_id, r.k, coalesce(list(e.newer) FILTER (e.newer IS NOT NULL), []) AS ns FROM ranked r LEFT JOIN edges e ON e.older = r.row_id GROUP BY ALL),
 walk(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN list_has_any(w.kept, n.ns) THEN w.kept ELSE list_append(w.kept, n.row_id) END FROM walk w JOIN newer_of n ON n.k = w.k + 1),
 keepers AS (SELECT unnest(kept) AS row_id FROM walk WHERE k = (SELECT max(k) FROM walk)),
 plan AS (SELECT e.newer AS keep, e.older AS drop_, e.similarity FROM edges e JOIN memories m ON m.row_id = e.newer WHERE e.newer IN (SELECT row_id FROM keepers) AND e.older NOT IN (SELECT row_id FROM keepers)
   QUALIFY row_number() OVER (PARTITION BY e.older ORDER BY m.updated_at DESC, e.newer) = 1)"""


@query(_with("RECURSIVE " + fx.MEMORIES_SQL, *_EDGES, _PLAN, 'SELECT keep, drop_ AS "drop", round(similarity, 6) AS similarity FROM plan'))
def dedupe_plan(spark, d):
    return dedupe.plan(_memories(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(_with("RECURSIVE " + fx.MEMORIES_SQL, *_EDGES, _PLAN, f"""SELECT row_id, CASE WHEN length(d.note) > length(m.note) THEN d.note ELSE m.note END AS note, greatest(m.pinned, coalesce(d.pinned, 0)) AS pinned, coalesce(d.n, 0) AS n_changes,
 CASE WHEN d.n IS NULL THEN updated_at ELSE {fx.NOW} END AS updated_at FROM memories m LEFT JOIN (SELECT keep AS row_id, arg_max(note, length(note) * 1000000000000 + updated_at) AS note, max(pinned) AS pinned, count(*) AS n FROM plan JOIN memories x ON x.row_id = drop_ GROUP BY 1) d USING (row_id)
 WHERE row_id NOT IN (SELECT drop_ FROM plan)"""))
def dedupe_apply(spark, d):
    rows = _memories(spark, d)
    after = dedupe.applied(rows, dedupe.plan(rows), fx.NOW)
    return after.select("row_id", "note", "pinned", F.size(text.changelog(F.col("metadata_json"))).alias("n_changes"), "updated_at")


@query(_with(fx.MEMORIES_SQL, "SELECT repo, note_normalized, count(*) AS rows FROM memories WHERE note_normalized <> '' GROUP BY ALL HAVING count(*) > 1"))
def exact_dup_clusters(spark, d):
    return dedupe.exact_clusters(_memories(spark, d), by_type=False)


@query(_with(fx.MEMORIES_SQL, "SELECT repo, type, note_normalized, count(*) AS rows FROM memories WHERE note_normalized <> '' GROUP BY ALL HAVING count(*) > 1"))
def exact_dup_clusters_by_type(spark, d):
    return dedupe.exact_clusters(_memories(spark, d), by_type=True)


@query(_with(fx.MEMORIES_SQL, "SELECT row_id FROM memories QUALIFY note_normalized = '' OR row_number() OVER (PARTITION BY repo, type, note_normalized ORDER BY pinned DESC, updated_at DESC, row_id DESC) = 1"))
def exact_dedupe_survivors(spark, d):
    return dedupe.exact_survivors(_memories(spark, d)).select("row_id")


# Reports


def _section_sql(line: str, titles: dict[str, str], rows: str, head: str) -> str:
    title = "CASE section " + " ".join(f"WHEN '{k}' THEN {sql.quoted(v)}" for k, v in titles.items()) + " END"
    order = "list_position([" + ", ".join(f"'{k}'" for k in ["pinned", *reports.TYPES]) + "], section)"
    return f""", sections AS (SELECT repo, section, {title} || chr(10) || string_agg({line}, chr(10) ORDER BY place) AS t FROM ({rows}) GROUP BY repo, section)
 SELECT repo, {head} || string_agg(t, chr(10) || chr(10) ORDER BY {order}) AS report FROM sections GROUP BY repo"""


_NL2 = "chr(10) || chr(10)"


@query(_with(fx.MEMORIES_SQL, f"r AS ({_REPORT})", _section_sql(f"'- (' || row_id || ' | legacy: ' || id || ') ' || {_PIN} || note || ' [tags: ' || {_TAGS} || ']'", {t: reports.type_heading(t) for t in reports.TYPES}, "SELECT *, type AS section FROM r WHERE place <= 10", f"'Repository context for ' || repo || chr(10) || 'Total memories: ' || (SELECT count(*) FROM r x WHERE x.repo = sections.repo AND x.place <= 10) || {_NL2}")))
def type_sections(spark, d):
    return reports.type_report(context.report_rows(_memories(spark, d), 10))


@query(_with(fx.MEMORIES_SQL, f"r AS ({_REPORT})", _section_sql("'- (' || row_id || ') ' || note", {"pinned": f"{reports.PIN}Pinned", **reports.TITLES}, "SELECT *, type AS section FROM r UNION ALL BY NAME SELECT *, 'pinned' AS section FROM r WHERE pinned = 1", f"'Context Summary: ' || repo || {_NL2}")))
def summary_sections(spark, d):
    return reports.summary(_memories(spark, d))


@query(_with(fx.MEMORIES_SQL, _spot(8), f"""SELECT repo, 'Repository context for ' || repo || chr(10) || 'Total: ' || count(*) || {_NL2} || string_agg('- (' || row_id || ' | ' || type || ') ' || CASE WHEN pinned = 1 THEN '{reports.PIN}' ELSE '' END || note || ' [tags: ' || {_TAGS} || ']', chr(10) ORDER BY spot) AS report FROM context GROUP BY repo"""))
def context_text(spark, d):
    return reports.context_text(context.assembled(_memories(spark, d), 8))


@query(_with(fx.MEMORIES_SQL, _spot(5), _section_sql(f"'- (' || row_id || ') ' || note || ' _(' || {_TAGS} || ')_'", {"pinned": f"## {reports.PIN}Pinned", **{k: f"## {v}" for k, v in reports.TITLES.items()}}, "SELECT *, spot AS place, CASE WHEN pinned = 1 THEN 'pinned' ELSE type END AS section FROM context", f"'# Context: ' || repo || {_NL2}")))
def startup_context(spark, d):
    return reports.context_markdown(context.assembled(_memories(spark, d), 5))


@query(_with(fx.MEMORIES_SQL, """dup AS (SELECT count(*) AS c, coalesce(sum(n - 1), 0) AS e FROM (SELECT count(*) AS n FROM memories WHERE repo = 'corpus/en' AND note_normalized <> '' GROUP BY note_normalized HAVING count(*) > 1)),
 same AS (SELECT coalesce(sum(n - 1), 0) AS e FROM (SELECT count(*) AS n FROM memories WHERE repo = 'corpus/en' AND note_normalized <> '' GROUP BY note_normalized, type HAVING count(*) > 1)),
 stale AS (SELECT count(*) AS n FROM memories WHERE repo = 'corpus/en' AND regexp_matches(note, '(^|[^A-Za-z0-9_/-])en($|[^A-Za-z0-9_/-])'))""", """SELECT unnest(['sibling_keys', 'sibling_rows', 'stale_mentions', 'duplicate_clusters', 'duplicate_extra_rows', 'removable_rows', 'rows_of_key', 'rows_in_all']) AS finding,
 unnest([0, 0, stale.n, dup.c, dup.e, same.e, (SELECT count(*) FROM memories WHERE repo = 'corpus/en'), (SELECT count(*) FROM memories)])::BIGINT AS value FROM dup, same, stale"""))
def doctor_report(spark, d):
    return reports.doctor(_memories(spark, d), fx.aliases(spark, d), "corpus/en")


# Keys


@query(_with(fx.ALIASES_SQL, "asked(id, key) AS (VALUES (1, 'en'), (2, 'corpus/fr'), (3, 'other/main'), (4, 'new'), (5, ''), (6, ' de '))", "SELECT id, CASE WHEN id = 3 THEN 'own/main' WHEN id = 5 THEN 'own/main' ELSE coalesce(canonical, trim(key)) END AS canonical, CASE WHEN id = 5 THEN 'workspace' WHEN id = 3 OR canonical IS NOT NULL THEN 'alias' ELSE 'input' END AS source FROM asked LEFT JOIN aliases ON alias = trim(key)"))
def resolve_alias(spark, d):
    asked = spark.createDataFrame([(1, "en"), (2, "corpus/fr"), (3, "other/main"), (4, "new"), (5, ""), (6, " de ")], "id int, input string").withColumn("workspace", F.lit("own/main"))
    return keys.resolved(asked, fx.aliases(spark, d))


@query(_with(fx.ALIASES_SQL, "SELECT canonical, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases FROM aliases GROUP BY 1"))
def alias_lists(spark, d):
    return keys.alias_lists(fx.aliases(spark, d)).select("canonical", F.array_join("aliases", "|").alias("aliases"))


_SCATTERED = "scattered AS (SELECT * REPLACE (CASE WHEN row_id % 5 = 0 THEN split_part(repo, '/', 2) WHEN row_id % 5 = 1 THEN 'old/' || split_part(repo, '/', 2) ELSE repo END AS repo) FROM memories)"


def _scattered(spark, d):
    """Notes whose keys have other forms, too."""
    rows = _memories(spark, d)
    last = F.element_at(F.split("repo", "/"), -1)
    return rows.withColumn("repo", F.when(F.col("row_id") % 5 == 0, last).when(F.col("row_id") % 5 == 1, F.concat(F.lit("old/"), last)).otherwise(F.col("repo"))).select(*rows.columns)


@query(_with(fx.MEMORIES_SQL, _SCATTERED, "SELECT repo, count(*) AS rows FROM scattered WHERE repo <> 'corpus/fr' AND split_part(repo, '/', -1) IN ('fr', 'corpus/fr') GROUP BY 1"))
def sibling_repos(spark, d):
    return keys.siblings(_scattered(spark, d), "corpus/fr")


_EN = r"(^|[^A-Za-z0-9_/-])en($|[^A-Za-z0-9_/-])"


@query(_with(fx.MEMORIES_SQL, f"SELECT row_id, repo, note FROM memories WHERE repo = 'corpus/fr' AND regexp_matches(note, '{_EN}')"))
def stale_mentions(spark, d):
    return keys.mentioning(_memories(spark, d), "en", "corpus/fr")


@query(_with(fx.MEMORIES_SQL, f"t AS (SELECT *, regexp_matches(note, '{_EN}') AS hit, {sql.boundary_replaced('note', 'en', 'corpus/en')} AS new FROM memories)", f"SELECT row_id, CASE WHEN hit THEN new ELSE note END AS note, CASE WHEN hit THEN {fx.norm_sql('new')} ELSE note_normalized END AS note_normalized, CASE WHEN hit THEN {fx.NOW} ELSE updated_at END AS updated_at FROM t"))
def rewrite_mentions(spark, d):
    return keys.rewritten(_memories(spark, d), "en", "corpus/en", fx.NOW).select("row_id", "note", "note_normalized", "updated_at")


@query(_with(fx.MEMORIES_SQL, _SCATTERED, "t AS (SELECT *, CASE WHEN repo IN ('en', 'old/en') THEN 'corpus/en' ELSE repo END AS after FROM scattered)", "SELECT after AS repo, count(*) AS rows FROM t GROUP BY 1"))
def merge_repo_keys(spark, d):
    after, _, _ = keys.merged(_scattered(spark, d), fx.aliases(spark, d), "old/en", "corpus/en", fx.NOW)
    return after.groupBy("repo").agg(F.count(F.lit(1)).alias("rows"))


@query(_with(fx.MEMORIES_SQL, _SCATTERED, "SELECT 0::BIGINT AS moved_aliases, count(*) FILTER (repo IN ('en', 'old/en')) AS moved_memories, 0::BIGINT AS rewritten_notes FROM scattered"))
def merge_repo_counts(spark, d):
    return keys.merged(_scattered(spark, d), fx.aliases(spark, d), "old/en", "corpus/en", fx.NOW)[2]


# Notes' life


@query(_with(fx.MEMORIES_SQL, "asked(ask_id, k) AS (VALUES (1, '7'), (2, 'm-11'), (3, '007'), (4, ' 12 '), (5, '1.0'), (6, 'none'), (7, ''))", "SELECT ask_id, coalesce(a.row_id, b.row_id) AS row_id FROM asked LEFT JOIN memories a ON trim(k) SIMILAR TO '[1-9][0-9]*' AND a.row_id::VARCHAR = trim(k) LEFT JOIN memories b ON b.id = trim(k)"))
def find_by_any_id(spark, d):
    asked = spark.createDataFrame([(1, "7"), (2, "m-11"), (3, "007"), (4, " 12 "), (5, "1.0"), (6, "none"), (7, "")], "ask_id int, id string")
    return memory.by_any_id(asked, _memories(spark, d))


@query(_with(fx.MEMORIES_SQL, "said AS (SELECT text || ' today' AS note FROM conversations WHERE role = 'user')", f"t AS (SELECT note, list_filter({sql.dates_sql('note', fx.DAY)}, lambda x: NOT contains(note, x)) AS p FROM said)", f"""SELECT repo, type, note, tags, pinned, updated_at FROM memories UNION ALL
 SELECT 'corpus/en', 'decision', CASE WHEN len(p) > 0 THEN note || ' (' || array_to_string(p, '; ') || ')' ELSE note END, '["Chat","b"]', 0, {fx.NOW} FROM t"""))
def insert_memory(spark, d):
    said = fx.incoming(spark, d).where("seq >= 0")
    new = said.withColumn("note", F.concat("note", F.lit(" today"))).withColumn("repo", F.lit("corpus/en")).withColumn("type", F.lit("decision")).withColumn("tags", F.array(F.lit(" Chat"), F.lit("b"), F.lit(""), F.lit("b")))
    after = memory.stored(_memories(spark, d), new, fx.NOW, F.to_date(F.lit(fx.DAY)))
    return after.select("repo", "type", "note", "tags", "pinned", "updated_at")


@query(_with(fx.MEMORIES_SQL, f"SELECT row_id, CASE WHEN row_id % 10 = 3 THEN 'Changed!' ELSE note END AS note, CASE WHEN row_id % 10 = 3 THEN 'changed' ELSE note_normalized END AS note_normalized, CASE WHEN row_id % 10 = 4 THEN 'issue' ELSE type END AS type, CASE WHEN row_id % 10 IN (3, 4) THEN {fx.NOW} ELSE updated_at END AS updated_at FROM memories"))
def update_memory(spark, d):
    rows = _memories(spark, d)
    last = F.col("row_id") % 10
    changes = rows.where(last.isin(3, 4, 5)).select("row_id", F.when(last == 3, F.lit("Changed!")).alias("content"), F.when(last == 4, F.lit("issue")).alias("memory_type"))
    return memory.updated(rows, changes, fx.NOW).select("row_id", "note", "note_normalized", "type", "updated_at")


@query(_with(fx.MEMORIES_SQL, f"SELECT row_id, CASE WHEN row_id % 10 = 3 THEN 1 ELSE pinned END AS pinned, CASE WHEN row_id % 10 = 3 THEN {fx.NOW} ELSE updated_at END AS updated_at FROM memories"))
def pin_memory(spark, d):
    rows = _memories(spark, d)
    return memory.pinned(rows, rows.where("row_id % 10 = 3"), True, fx.NOW).select("row_id", "pinned", "updated_at")


@query(_with(fx.MEMORIES_SQL, f"SELECT row_id, CASE WHEN pinned = 1 THEN 0 ELSE pinned END AS pinned, CASE WHEN pinned = 1 THEN {fx.NOW} ELSE updated_at END AS updated_at FROM memories"))
def unpin_memory(spark, d):
    rows = _memories(spark, d)
    return memory.pinned(rows, rows.where("pinned = 1"), False, fx.NOW).select("row_id", "pinned", "updated_at")


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, "SELECT 'memory' AS kind, row_id FROM memories WHERE row_id % 7 <> 0 UNION ALL SELECT 'vector', memory_rowid FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.row_id = v.memory_rowid AND m.row_id % 7 = 0)"))
def delete_cascade(spark, d):
    rows, held = memory.deleted(_memories(spark, d), fx.vectors(spark, d), _memories(spark, d).where("row_id % 7 = 0").select("row_id"))
    return rows.select(F.lit("memory").alias("kind"), "row_id").unionByName(held.select(F.lit("vector").alias("kind"), F.col("memory_rowid").alias("row_id")))


@query()
def remember_batch(spark, d):
    after = memory.remembered(_memories(spark, d), fx.incoming(spark, d), fx.NOW, F.to_date(F.lit(fx.DAY)))
    return after.select("repo", "type", "note", "tags", "updated_at", F.size(text.changelog(F.col("metadata_json"))).alias("n_changes"))


@query(_with(fx.MEMORIES_SQL, "SELECT row_id, id, repo, type, note, '[]' AS tags, created_at, created_at AS updated_at, 0 AS pinned, '{}' AS metadata_json, note_normalized FROM memories"))
def migrate_snapshot(spark, d):
    from notewell.sources.store import migrated

    return migrated(_memories(spark, d).select("row_id", "id", "repo", "type", "note", "created_at"))


# Vectors that follow their notes


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, """SELECT row_id AS memory_rowid, CASE WHEN row_id % 10 = 3 THEN 256 ELSE coalesce(v.dim, 256) END AS dim, CASE WHEN v.dim IS NULL OR row_id % 10 = 3 THEN 1 ELSE 1000 END AS version
 FROM memories LEFT JOIN vectors v ON memory_rowid = row_id WHERE v.dim IS NOT NULL OR row_id % 10 = 3"""))
def vector_refresh(spark, d):
    """After an edit of every tenth note, its vector is made anew and no other changes."""
    rows, held = _memories(spark, d), fx.vectors(spark, d)
    after = memory.updated(rows, rows.where("row_id % 10 = 3").select("row_id", F.lit("Changed!").alias("content"), F.lit(None).cast("string").alias("memory_type")), fx.NOW)
    kept = vectors.current_only(held, rows, after)
    edited = after.join(rows.select("row_id", F.col("note").alias("old")), "row_id").where("note <> old").drop("old")
    full = vectors.backfilled(edited.select("row_id", "note"), kept, F.lit(fx.NOW))
    return full.join(rows.select(F.col("row_id").alias("memory_rowid")), "memory_rowid", "left_semi").select("memory_rowid", "dim", "version")


@query(_with(fx.MEMORIES_SQL, fx.VECTORS_SQL, "dealt AS (SELECT memory_rowid, CASE WHEN memory_rowid % 3 = 0 THEN 32 ELSE dim END AS dim, CASE WHEN memory_rowid % 4 = 0 THEN 999 ELSE version END AS version FROM vectors)",
 "SELECT row_id FROM memories WHERE row_id NOT IN (SELECT memory_rowid FROM dealt WHERE dim = 64 AND version = 1000)"))
def vector_meta_filter(spark, d):
    """Vectors of another dimension or an older version count as lacking."""
    last = F.col("memory_rowid")
    dealt = fx.vectors(spark, d).withColumn("dim", F.when(last % 3 == 0, 32).otherwise(F.col("dim"))).withColumn("version", F.when(last % 4 == 0, 999).otherwise(F.col("version")))
    return vectors.missing(_memories(spark, d), dealt, 64, 1000).select("row_id")


# Keys that are learned, messages


_NEW_ALIASES = [(" fr ", "corpus/fr-moved", 5), ("fresh", "corpus/new", 6), ("", "corpus/x", 7), ("blank", " ", 8)]


@query(_with(fx.ALIASES_SQL, "fresh(alias, canonical, created_at) AS (VALUES ('fr', 'corpus/fr-moved', 5), ('fresh', 'corpus/new', 6))",
 "SELECT coalesce(a.alias, f.alias) AS alias, coalesce(f.canonical, a.canonical) AS canonical, coalesce(a.created_at, f.created_at)::BIGINT AS created_at FROM aliases a FULL JOIN fresh f USING (alias)"))
def upsert_alias(spark, d):
    return keys.alias_upserted(fx.aliases(spark, d), spark.createDataFrame(_NEW_ALIASES, "alias string, canonical string, created_at long"))


_ASKED_KEYS = [(1, "en"), (2, "corpus/fr"), (3, "other/main"), (4, "new"), (5, ""), (6, " de ")]


@query(_with(fx.ALIASES_SQL, "asked(id, key) AS (VALUES (1, 'en'), (2, 'corpus/fr'), (3, 'other/main'), (4, 'new'), (6, 'de'))",
 f"SELECT DISTINCT key AS alias, CASE WHEN id = 3 THEN 'own/main' ELSE canonical END AS canonical, {fx.NOW}::BIGINT AS created_at FROM asked LEFT JOIN aliases ON alias = key WHERE id = 3 OR (canonical IS NOT NULL AND canonical <> key)"))
def learned_aliases(spark, d):
    asked = spark.createDataFrame(_ASKED_KEYS, "id int, input string").withColumn("workspace", F.lit("own/main"))
    return keys.links_of(asked, fx.aliases(spark, d), fx.NOW)


@query(_with(fx.ALIASES_SQL, f"remotes AS (SELECT page_id AS id, url, regexp_extract(url, '([^/]*)/*$', 1) AS folder, {_REMOTE_SQL} AS key FROM pages)", """SELECT id, '{"canonical":"' || coalesce(key, folder) || '","source":"' || CASE WHEN key IS NULL THEN 'folder' ELSE 'git' END || '","aliases":["' ||
 CASE WHEN EXISTS (SELECT 1 FROM aliases a WHERE a.alias = folder) OR folder = coalesce(key, folder) THEN coalesce(key, folder) ELSE key || '","' || folder END || '"]}' AS payload FROM remotes"""))
def resolve_workspace(spark, d):
    rows = fx.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("/home/of/"), F.regexp_extract("url", "([^/]*)/*$", 1)).alias("path"), F.col("url").alias("remote"))
    return keys.workspace_payload(keys.workspaces(rows, fx.aliases(spark, d)))


@query(_with(fx.MEMORIES_SQL, "asked(ask_id, k, row_id) AS (SELECT row_id, row_id::VARCHAR, row_id FROM memories UNION ALL SELECT -1, 'no-such', NULL)", "SELECT ask_id, CASE WHEN m.row_id IS NULL THEN 'Memory ' || k || ' not found.' ELSE 'Pinned memory ' || m.row_id || ': ' || note END AS message FROM asked LEFT JOIN memories m USING (row_id)"))
def pin_message(spark, d):
    rows = _memories(spark, d)
    return reports.said("pin", _every_id(spark, rows), rows)


@query(_with(fx.MEMORIES_SQL, "asked(ask_id, k, row_id) AS (SELECT row_id, row_id::VARCHAR, row_id FROM memories UNION ALL SELECT -1, 'no-such', NULL)", "SELECT ask_id, CASE WHEN m.row_id IS NULL THEN 'Memory ' || k || ' not found.' ELSE 'Deleted memory ' || m.row_id || ' (legacy: ' || id || ').' END AS message FROM asked LEFT JOIN memories m USING (row_id)"))
def delete_message(spark, d):
    rows = _memories(spark, d)
    return reports.said("delete", _every_id(spark, rows), rows)


def _every_id(spark, rows):
    """Every row by its number, and one that isn't there."""
    return rows.select(F.col("row_id").alias("ask_id"), F.col("row_id").cast("string").alias("id")).unionByName(spark.createDataFrame([(-1, "no-such")], "ask_id long, id string"))


@query(_with(fx.MEMORIES_SQL, f"""SELECT row_id, 'Memory ' || row_id || ' updated successfully.' || chr(10) || 'id: ' || row_id || chr(10) || 'legacy_id: ' || id || chr(10) || 'repo: ' || repo || chr(10) || 'memory_type: ' || type || chr(10) || 'content: ' || note || chr(10) ||
 'tags: ' || {_TAGS} || chr(10) || 'pinned: ' || CASE WHEN pinned = 1 THEN 'true' ELSE 'false' END || chr(10) || 'created_at: ' || created_at || chr(10) || 'updated_at: ' || updated_at AS report FROM memories"""))
def update_message(spark, d):
    return reports.row_text(_memories(spark, d))


@query(_with("RECURSIVE " + fx.MEMORIES_SQL, *_EDGES, _PLAN, "SELECT m.repo, 'Merged ' || count(*) || ' duplicate pair(s) in ' || m.repo || '.' AS message FROM plan JOIN memories m ON m.row_id = keep GROUP BY m.repo"))
def dedupe_message(spark, d):
    rows = _memories(spark, d)
    return reports.plan_said(dedupe.plan(rows), rows)


@query("SELECT DISTINCT lang AS repo, 'No memories found for ' || lang || ' matching \"x\".' AS report, '# Context: ' || lang || chr(10) || chr(10) || 'No memories found for \"x\".' AS markdown FROM documents")
def empty_message(spark, d):
    repos = fx.table(spark, d, "documents").select(F.col("lang").alias("repo")).distinct()
    return repos.select("repo", reports.empty_context(F.col("repo"), "x").alias("report"), reports.empty_context(F.col("repo"), "x", markdown=True).alias("markdown"))


@query(f"SELECT 1::BIGINT AS row_id, 'n-1' AS id, 'own/new' AS repo, 'convention' AS type, 'Welcome.' AS note, '[]' AS tags, {fx.NOW}::BIGINT AS created_at, 'welcome' AS note_normalized")
def starter_seed(spark, d):
    """Into a store without notes; one with notes stays as it is."""
    rows = _memories(spark, d)
    some, none = memory.seeded(rows, "own/new", "Welcome.", fx.NOW), memory.seeded(rows.limit(0), "own/new", "Welcome.", fx.NOW)
    return none.unionByName(some.where("repo = 'own/new'")).select("row_id", "id", "repo", "type", "note", "tags", "created_at", "note_normalized")
