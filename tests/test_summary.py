import duckdb
import pytest

from notewell.operators import reports
from notewell.plans import catalog
from notewell.schema import MEMORIES, TITLES, TYPES


def _answers(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    own = catalog.QUERIES["summary_sections"](spark, str(path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
        return dict(map(tuple, own.collect())), dict(db.execute(catalog.ORACLES["summary_sections"]).fetchall()), own.columns


def test_sections_and_repos_without_lines_as_in_sql(spark, tmp_path):
    rows = [
        (1, "first", "en", "s", 0), (2, None, "en", "s", 1), (97, "pinned", "en", "s", 0), (4, "", "en", "s", 2), (5, "another", "en", "s", 8), (194, "only pinned", "es", "s", 3),
        (291, None, "fr", "s", 3), (8, None, "fr", "s", 4), (9, "\n- (1) looks like a line\n", "de", "s", 5),
    ]
    own, oracle, columns = _answers(spark, tmp_path, rows)
    assert columns == ["repo", "report"]
    assert own == oracle
    assert "Bug Fixes" not in own["corpus/en"] and own["corpus/fr"] is None


def test_many_notes_in_the_order_of_sql(spark, tmp_path):
    rows = [(i, f"note {i} " * (i % 7), ("en", "de")[i % 3 == 0], "s", i * 31 % 17) for i in range(2_000)]
    own, oracle, _ = _answers(spark, tmp_path, rows)
    assert own == oracle and len(own) == 2


@pytest.mark.parametrize("updated", [[5, 5, 5], [1, None, 2]])
def test_order_within_a_section(spark, updated):
    rows = [(i, f"m-{i}", "r", TYPES[0], f"n{i}", "[]", 0, u, 0, "{}", "") for i, u in enumerate(updated)]
    got = reports.summary(spark.createDataFrame(rows, MEMORIES)).first().report
    newest = sorted(range(3), key=lambda i: (updated[i] is None, -(updated[i] or 0), i))
    assert got == f"Context Summary: r\n\n{TITLES[TYPES[0]]}\n" + "\n".join(f"- ({i}) n{i}" for i in newest)


def test_notes_of_no_known_type(spark):
    rows = [(i, f"m-{i}", repo, kind, f"n{i}", "[]", 0, 0, pinned, "{}", "") for i, (repo, kind, pinned) in enumerate([("r", None, 1), ("r", "other", 0), ("s", None, 0), (None, TYPES[0], 0)])]
    got = dict(map(tuple, reports.summary(spark.createDataFrame(rows, MEMORIES)).collect()))
    assert got == {"r": f"Context Summary: r\n\n{reports.PIN}Pinned\n- (0) n0", "s": None, None: None}


def test_texts_are_gathered_once_and_written_apart(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.QUERIES["summary_sections"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "array_join" not in plan
    executed = catalog.QUERIES["summary_sections"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 2 and executed.count("FileScan") == 1
    assert executed.index("REPARTITION_BY_COL") < executed.index("ObjectHashAggregate")  # the last step before whatever uses the reports
