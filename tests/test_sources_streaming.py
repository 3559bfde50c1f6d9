import datetime as dt

from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.sources import files
from brindle.streaming import analytics as stream


def test_read_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a note.txt").write_text("alpha beta")
    (tmp_path / "deep/b.md").write_text("# سلام")
    (tmp_path / "c.pdf").write_bytes(b"%PDF broken")
    (tmp_path / "d.docx").write_bytes(b"PK")
    (tmp_path / "e.bin").write_bytes(b"\xff\xfe\x00")
    got = {r.file_name: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a note.txt"].content == "alpha beta" and got["a note.txt"].title == "a note" and got["a note.txt"].file_size == 10
    assert got["b.md"].content == "# سلام"
    assert got["c.pdf"].content.startswith("[Error extracting PDF content") and got["d.docx"].content == files.WORD_PLACEHOLDER and got["e.bin"].content == files.OTHER_PLACEHOLDER
    pages = files.read_files(spark, str(tmp_path), lambda data: ["one", "two"]).where("file_name = 'c.pdf'").first()
    assert pages.content == "one\ntwo"


def test_contents_and_tables(spark, tmp_path):
    rows = [(1, " ", "text", dt.datetime(2024, 1, 1), "my.file.txt"), (2, "T", "", dt.datetime(2024, 1, 1), None), (3, None, "x", None, None)]
    made = files.from_contents(spark.createDataFrame(rows, "doc_id bigint, title string, content string, date_added timestamp, file_name string"))
    assert {(r.doc_id, r.title, r.file_size) for r in made.collect()} == {(1, "my.file", 4), (3, "", 1)}
    files.write_json(made, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")).count() == 2
    files.write_table(made, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).count() == 2
    more = made.unionByName(made.limit(1).withColumn("doc_id", F.lit(8).cast("bigint")).withColumn("content", F.lit("one\ntwo\n")).withColumn("file_name", F.lit("A.MD")))
    written = {r.doc_id: r for r in files.write_texts(more, str(tmp_path / "x")).collect()}
    assert {p.name: p.read_text() for p in (tmp_path / "x").iterdir()} == {"1.txt": "text", "3": "x", "8.MD": "one\ntwo\n"} and written[8].file_size == 8
    assert files.file_exists(spark, written[8].file_path)
    files.delete_file(spark, written[8].file_path)
    files.delete_file(spark, written[8].file_path)
    assert not files.file_exists(spark, written[8].file_path)


def log(spark, path, start, n):
    rows = [(start + i, ["Alpha", "beta "][i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * (start + i)), i, 1.0, i % 3) for i in range(n)]
    spark.createDataFrame(rows, "event_id bigint, query string, ts timestamp_ntz, result_count int, search_time_ms double, doc_id bigint").write.mode("append").parquet(path)


def test_streams_equal_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, path, 0, 10)
    log(spark, path, 5, 10)
    read = stream.read_log(spark, path, 1)
    once = stream.without_redelivery(stream.with_event_time(read), "event_id")
    folder = lambda name: (str(tmp_path / name / "table"), str(tmp_path / name / "checkpoint"))
    kept = stream.append_to_folder(once.select("event_id"), *folder("once"))
    assert sorted(r[0] for r in kept.collect()) == list(range(15))
    run = lambda df, keys, name: stream.run_to_folder(df, folder(name)[0], keys, folder(name)[1])
    volume = run(stream.volume_by_hour(stream.with_event_time(read)), ["hour"], "volume")
    batch = spark.read.parquet(path).groupBy(F.date_trunc("hour", "ts").alias("hour")).count()
    assert sorted(map(tuple, volume.select("hour", "n_searches").collect())) == sorted(map(tuple, batch.collect()))
    assert sum(r.n_searches for r in stream.last_hours(volume, 1).collect()) == 7  # the hours with an event in the last hour, each whole; event 9 came twice
    assert {(r.query, r.n_searches) for r in run(stream.query_rollup(read), ["query"], "rollup").collect()} == {("alpha", 10), ("beta", 10)}
    assert sum(r.n_clicks for r in run(stream.click_counts(read), ["doc_id"], "clicks").collect()) == 20
    # run again, a stream takes in what is new
    log(spark, path, 20, 4)
    assert {(r.query, r.n_searches) for r in run(stream.query_rollup(stream.read_log(spark, path, 1)), ["query"], "rollup").collect()} == {("alpha", 12), ("beta", 12)}


def test_keep_newest(spark, tmp_path):
    path, kept = str(tmp_path / "log"), str(tmp_path / "kept")
    log(spark, path, 0, 10)
    log(spark, path, 10, 10)
    q = stream.read_log(spark, path, 1).writeStream.foreachBatch(stream.keep_newest(kept, 7)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in stream.newest(spark, kept).collect()) == list(range(13, 20))


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "Vector search", "vector index", dt.datetime(2024, 1, 1), False, "a.txt", None, 10), (2, "Other", "nothing here", dt.datetime(2024, 1, 2), False, None, None, 5)],
        "doc_id bigint, title string, content string, date_added timestamp, is_indexed boolean, file_name string, file_path string, file_size bigint",
    )
    e = Engine(spark, docs)
    e.index_all(str(tmp_path / "index"))
    assert [r.doc_id for r in e.search("vectors").collect()] == [1]
    page = e.ranked_search("vectors")
    assert page.total == 1 and page.error is None and "<mark>" in page.results.first().snippet.text
    assert [r[0] for r in e.boolean_search("vector AND NOT nothing").collect()] == [1]
    assert e.suggest("vectr").first().term == "vector" and e.correct("vectr").first().corrected_query == "vector"
    assert e.expand(["search"])[0] == "search"
    assert e.index_page().first().n_docs == 2 and e.facets().count() > 0 and e.filter_options().first().n_docs == 2
    assert e.statistics().first().n_docs == 2 and e.analytics().first().n_searches == 1 and e.recent_searches().count() == 1
    e.record_click("Vectors", 1)
    e.record_click("vectors ", 1)
    rolled = e.query_rollup().first()
    assert (rolled.query, rolled.n_clicks, rolled.n_clicked_docs, rolled.ctr) == ("vectors", 2, 1, 2.0) and e.analytics().first().n_clicks == 2
    assert [tuple(r) for r in e.popular_documents().collect()] == [(1, 2)] and e.log.maxlen == e.clicks.maxlen == 1000
    e.delete(docs.where("doc_id = 1"))
    assert e.search("vector").count() == 0 and e.index.where("doc_id = 1").count() == 0
    e.add(docs.where("doc_id = 1"))
    e.index_documents(docs.where("doc_id = 1"))
    e.update(docs.where("doc_id = 2").withColumn("content", F.lit("vector")))
    assert {r.doc_id for r in e.search("vector").collect()} == {1, 2}
    e.clear_index()
    assert e.index.count() == 0 and [r.doc_id for r in e.listing().collect()] == [2, 1] and e.get(2).count() == 1
    assert e.filter(required=["vector"]).count() == 2
