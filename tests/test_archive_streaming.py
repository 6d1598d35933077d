import json
import os

from pyspark.sql import functions as F

from corpusgrid.sources import archive
from corpusgrid.streaming import ingest, lookup

FULL = {"_id": "a1", "abstract": "Abs", "headline": {"main": "Head", "kicker": None}, "news_desk": "Desk",
        "pub_date": "2020-01-02T03:04:05+0000", "snippet": "Snip", "section_name": "Sec", "source": "Src",
        "type_of_material": "News", "word_count": 42}


def _doc(**changes):
    d = dict(FULL)
    for k, v in changes.items():
        if v == "<absent>":
            d.pop(k, None)
        else:
            d[k] = v
    return d


def _month(docs):
    return json.dumps({"response": {"docs": docs}})


def _write(base, year, month, name, text):
    folder = f"{base}/year={year}/month={month}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_parse_rules(spark):
    docs = [
        _doc(_id="full"),
        _doc(_id="no_abstract", abstract="<absent>"),
        _doc(_id="no_headline", headline="<absent>"),
        _doc(_id="no_desk", news_desk="<absent>"),
        _doc(_id="no_pub", pub_date="<absent>"),
        _doc(_id="no_snippet", snippet="<absent>"),
        _doc(_id="nulls", abstract=None, snippet=None),
        _doc(_id="short_date", pub_date="2020-01-02"),
        _doc(_id="no_section", section_name="<absent>", source="<absent>", type_of_material="<absent>",
             word_count="<absent>"),
        _doc(_id="null_section", section_name=None),
        _doc(_id="null_headline_main", headline={"main": None}),
        _doc(_id="<absent>"),
    ]
    raw = spark.createDataFrame([(_month(docs),), ('{"response": {"docs": [ broken',)], "value string")
    articles, rejects = archive.parse_archive(raw)
    got = {r["id"]: r for r in articles.collect()}
    assert set(got) == {"full", "nulls", "no_section", "null_section", "null_headline_main"}
    f = got["full"]
    assert (f["abstract"], f["headline"], f["desk"], f["date"], f["time"], f["section"], f["snippet"],
            f["source"], f["type"], f["word_count"]) == ("Abs", "Head", "Desk", "2020-01-02", "03:04:05", "Sec",
                                                         "Snip", "Src", "News", 42)
    assert str(f["pub_date"]) == "2020-01-02"
    assert got["nulls"]["abstract"] is None and got["nulls"]["snippet"] is None
    ns = got["no_section"]
    assert (ns["section"], ns["source"], ns["type"], ns["word_count"]) == ("EMPTY", "EMPTY", "EMPTY", 0)
    assert got["null_section"]["section"] is None
    assert got["null_headline_main"]["headline"] is None
    reasons = sorted(r["reason"] for r in rejects.collect())
    assert reasons == ["document without _id", "unreadable file"]


def test_bulk_load_and_month_report(spark, tmp_dir):
    base = f"{tmp_dir}/archive"
    _write(base, 2020, 1, "m.json", _month([_doc(_id="x1"), _doc(_id="x2")]))
    _write(base, 2020, 3, "m.json", _month([_doc(_id="x3", pub_date="2020-03-09T00:00:00+0000")]))
    _write(base, 2020, 4, "m.json", "{not json")
    articles, rejects = archive.bulk_load(spark, base)
    assert articles.count() == 3 and rejects.count() == 1
    cal = archive.month_calendar(spark, "2020-01-15", "2020-04-02")
    rep = {(r["year"], r["month"]): r["n_rows"] for r in archive.month_report(cal, articles).collect()}
    assert rep == {(2020, 1): 2, (2020, 2): 0, (2020, 3): 1, (2020, 4): 0}


def test_day_interval(spark):
    df = spark.createDataFrame([("2020-03-01",)], "d string")
    r = df.select(archive.day_interval(F.col("d"), 1).alias("x")).collect()[0]["x"]
    assert (r["that_day"], r["day_before"]) == (20200229, 20200228)


def test_incremental_ingest_dedup_and_backfill(spark, tmp_dir):
    src, tgt, ck = f"{tmp_dir}/src", f"{tmp_dir}/tgt", f"{tmp_dir}/ck"
    _write(src, 2020, 2, "a.json", _month([_doc(_id="p1"), _doc(_id="p1"), _doc(_id="p2")]))
    q = ingest.start_ingest(spark, src, tgt, ck)
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(tgt).collect()) == ["p1", "p2"]
    # a back-filled older month and a repeat of a known article arrive later
    _write(src, 2019, 11, "b.json", _month([_doc(_id="old", pub_date="2019-11-05T00:00:00+0000"), _doc(_id="p2")]))
    q = ingest.start_ingest(spark, src, tgt, ck)
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(tgt).collect()) == ["old", "p1", "p2"]


def test_stream_lookup(spark, tmp_dir):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "doc_id long, embedding array<double>")
    qpath = f"{tmp_dir}/queries"
    spark.createDataFrame([(10, [1.0, 0.05])], "query_id long, embedding array<double>").write.parquet(qpath)
    qs = spark.readStream.schema("query_id long, embedding array<double>").parquet(qpath)
    q = lookup.start_lookup(spark, qs, corpus, f"{tmp_dir}/ans", f"{tmp_dir}/ck2", k=2)
    q.awaitTermination()
    got = [(r["rank"], r["neighbor_id"]) for r in spark.read.parquet(f"{tmp_dir}/ans").orderBy("rank").collect()]
    assert got == [(1, 1), (2, 3)]


def test_stream_lookup_of_texts(spark, tmp_dir):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    qpath = f"{tmp_dir}/texts"
    spark.createDataFrame([(7, "aaaa"), (8, "b")], "query_id long, text string").write.parquet(qpath)
    qs = spark.readStream.schema("query_id long, text string").parquet(qpath)
    embed = lambda b: b.select("query_id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"))
    q = lookup.start_lookup(spark, qs, corpus, f"{tmp_dir}/ans3", f"{tmp_dir}/ck3", k=1, embed=embed)
    q.awaitTermination()
    got = {r["query_id"]: r["neighbor_id"] for r in spark.read.parquet(f"{tmp_dir}/ans3").collect()}
    assert got == {7: 1, 8: 1}


def test_parse_as_bytes(spark):
    raw = spark.createDataFrame([(_month([_doc(_id="u", abstract="é")]),)], "value string")
    art, _ = archive.parse_archive(raw, as_bytes=True)
    assert bytes(art.collect()[0]["abstract"]) == "é".encode("utf8")


def test_bulk_load_json_lines(spark, tmp_dir):
    base = f"{tmp_dir}/jl"
    _write(base, 2021, 5, "m.jsonl", _month([_doc(_id="j1")]) + "\n" + _month([_doc(_id="j2"), _doc(_id="j3")]) + "\n")
    articles, rejects = archive.bulk_load(spark, base, whole_files=False)
    assert sorted(r["id"] for r in articles.collect()) == ["j1", "j2", "j3"] and rejects.count() == 0


def test_ingest_reads_only_the_batch_months(spark, tmp_dir):
    src, tgt, ck = f"{tmp_dir}/src", f"{tmp_dir}/tgt", f"{tmp_dir}/ck"
    months = [f"2019-{m:02d}-03T00:00:00+0000" for m in range(1, 7)]
    for m, day in enumerate(months, 1):
        _write(src, 2019, m, "a.json", _month([_doc(_id=f"a{m}", pub_date=day)]))
    ingest.start_ingest(spark, src, tgt, ck, max_files_per_trigger=2).awaitTermination()
    fresh = spark.createDataFrame([("a2", 2019, 2), ("new", 2019, 2)], "id string, year int, month int")
    seen = ingest.known_ids(spark.read.parquet(tgt), fresh, "other")
    assert [r["id"] for r in seen.collect()] == ["a2"]
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month#" in plan.split("PartitionFilters")[1].split("]")[0]
    # a stream of its own (another checkpoint) brings everything again, with one new article in an old month
    _write(src, 2019, 3, "b.json", _month([_doc(_id="late", pub_date=months[2]), _doc(_id="a3", pub_date=months[2])]))
    ingest.start_ingest(spark, src, tgt, f"{tmp_dir}/ck2", max_files_per_trigger=3).awaitTermination()
    rows = spark.read.parquet(tgt).collect()
    assert sorted(r["id"] for r in rows) == ["a1", "a2", "a3", "a4", "a5", "a6", "late"]


def test_ingest_batch_runs_again(spark, tmp_dir):
    tgt = f"{tmp_dir}/tgt"
    first = spark.createDataFrame([("f1", _month([_doc(_id="x"), _doc(_id="y")]))], "path string, value string")
    ingest.upsert_batch(spark, first, tgt, batch="s-0")
    second = spark.createDataFrame([("f2", _month([_doc(_id="y"), _doc(_id="z"), _doc(_id="<absent>")]))], "path string, value string")
    for _ in range(2):                     # the same batch twice: its own output is replaced, not doubled
        ingest.upsert_batch(spark, second, tgt, rejects=f"{tmp_dir}/rej", batch="s-1")
    rows = spark.read.parquet(tgt).collect()
    assert sorted((r["id"], r["batch"]) for r in rows) == [("x", "s-0"), ("y", "s-0"), ("z", "s-1")]
    assert spark.read.parquet(f"{tmp_dir}/rej").count() == 1
    # an article without a date has a partition of its own
    undated = spark.createDataFrame([("f3", _month([_doc(_id="u", pub_date="9999-99-99T00:00:00+0000")]))], "path string, value string")
    for b in ("s-2", "s-3"):
        ingest.upsert_batch(spark, undated, tgt, batch=b)
    assert spark.read.parquet(tgt).where("id = 'u'").count() == 1
    # scope="all" also finds an id that came with another month before
    moved = spark.createDataFrame([("f4", _month([_doc(_id="x", pub_date="2021-07-01T00:00:00+0000")]))], "path string, value string")
    ingest.upsert_batch(spark, moved, tgt, batch="s-4", scope="all")
    assert spark.read.parquet(tgt).where("id = 'x'").count() == 1


def test_stream_lookup_on_a_stored_index(spark, tmp_dir):
    from corpusgrid.operators import models, vector_index
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "blue sky above"), (3, "green apple tree"), (4, "")], "doc_id long, text string")
    vector_index.build_index(models.hashed_embeddings(docs), f"{tmp_dir}/index", cells=2)
    spark.createDataFrame([(7, "an apple pie"), (8, "the blue sky"), (9, "...")], "query_id long, text string").repartition(2).write.parquet(f"{tmp_dir}/q")
    qs = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/q")
    q = lookup.start_lookup(spark, qs, None, f"{tmp_dir}/ans", f"{tmp_dir}/ck", k=1, index=f"{tmp_dir}/index", probes=None,
                            embed=lambda b: models.hashed_embeddings(b, "text", "query_id"), texts=docs)
    q.awaitTermination()
    got = {r["query_id"]: r["text"] for r in spark.read.parquet(f"{tmp_dir}/ans").collect()}
    assert got[7] == "red apple pie" and got[8] == "blue sky above"


def test_a_month_is_written_together(spark, tmp_dir):
    import glob

    from corpusgrid.plans import catalog
    spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'src1' AS source", "10 AS n_chars").write.parquet(
        f"{tmp_dir}/sf/documents.parquet")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # as if no partition were small
    try:
        catalog._land(spark, f"{tmp_dir}/sf", f"{tmp_dir}/src", copies=2)
        ingest.start_ingest(spark, f"{tmp_dir}/src", f"{tmp_dir}/tgt", f"{tmp_dir}/ck", whole_files=False).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert len(glob.glob(f"{tmp_dir}/src/*/*/part-*")) == 2 * 5                  # 134 days: five months, two copies
    assert len(glob.glob(f"{tmp_dir}/tgt/*/*/*/part-*")) == 5
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_dir}/tgt").collect()) == sorted(f"d{i}" for i in range(400))


def test_known_ids_of_many_months(spark, tmp_dir):
    rows = [(f"a{i}", 1000 + i // 12, 1 + i % 12, "b") for i in range(60)] + [("u", None, None, "b")]
    held = spark.createDataFrame(rows, "id string, year int, month int, batch string")
    fresh = spark.createDataFrame([(None, 1000 + i // 12, 1 + i % 12) for i in range(0, 30_000, 7)], "id string, year int, month int")
    ids = lambda f: sorted(r["id"] for r in ingest.known_ids(held, f, "other").collect())
    assert ids(fresh) == sorted(f"a{i}" for i in range(0, 60, 7))
    assert ids(fresh.unionByName(spark.createDataFrame([(None, None, None)], fresh.schema))) == sorted(["u", *(f"a{i}" for i in range(0, 60, 7))])
    assert ids(fresh.where("false")) == []
