"""Registered queries against their SQL on small tables of odd rows."""

import duckdb

import __spark_entry__ as entry
from vocalis.operators import reading
from vocalis.plans import catalogue as C


def differing(spark, folder, name, **tables):
    """Rows that only the query or only its SQL gives over tables: name to (schema, rows)."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    entry.queries()[name](spark, str(folder)).write.mode("overwrite").parquet(f"{folder}/out")
    con.execute(f"create table want as {entry.oracle_sql()[name]}")
    columns = ", ".join(f'"{c}"' for c, *_ in con.execute("describe want").fetchall())
    con.execute(f"create view got as select {columns} from read_parquet('{folder}/out/*.parquet')")
    return con.execute("select * from (from got except all from want) union all (from want except all from got)").fetchall()


def test_extract_pages_with_letter_spaced_runs(spark, tmp_path):
    pages = [(i, f"http://a.long.name/of/page/{i}", f"<html><body><p>es es {'ó ' * 12}ß ß ß ß ß</p><p>n o t a</p><div>v\ne\tl o c e {i}</div></body></html>") for i in range(10)]
    assert differing(spark, tmp_path, "extract_pages", pages=("page_id long, url string, html string", pages)) == []


TEXTS = ["Una frase. Poi un'altra", "fine.", " ", "", None, "Il dott. Rossi va. " * 300, "senza fine " * 50]


def test_layout_within_rows_is_that_by_rows_and_shuffles_nothing(spark, tmp_path, monkeypatch):
    docs = ("doc_id long, text string, n_chars long", [(i, t, len(t or "")) for i, t in enumerate(TEXTS)])
    assert differing(spark, tmp_path, "line_boxes", documents=docs) == []
    one = reading.laid_out(C.placed_arrays(C.table(spark, tmp_path, "documents")))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "LONG", 20)
    assert differing(spark, tmp_path, "overlay_boxes", documents=docs) == []


def test_words_are_timed_without_a_shuffle_and_found_in_their_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reading, "TIMED", 3)
    docs = ("doc_id long, text string, n_chars long", [(i, t, len(t or "")) for i, t in enumerate(TEXTS)])
    events = ("event_id long", [(i,) for i in range(2_000)])
    assert differing(spark, tmp_path, "word_at", documents=docs, events=events) == []
    plan = reading.aligned_words(C._clips(spark, tmp_path), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_costly_rows_of_a_small_file_are_many_tasks(spark):
    for name in ("lexicon", "speech_text"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4
