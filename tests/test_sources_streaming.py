import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, paged
from millrace.streaming import state


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "a long").collect()
    assert [r["a"] for r in files.read_jsonl(spark, str(p), "a long", strict=False).collect()] == [1, 2]
    g = tmp_path / "b.jsonl.gz"
    g.write_bytes(files.gzip_bytes(b'{"a": 3}\n\n{"a": 4}\n'))
    assert g.read_bytes() == files.gzip_bytes(gzip.decompress(g.read_bytes()))
    assert files.inspect_gzip(str(g))["rows"] == 2
    assert files.read_jsonl(spark, str(g), "a long").count() == 2
    files.unpack_gzip(str(g), str(tmp_path / "c"))
    with pytest.raises(FileExistsError):
        files.unpack_gzip(str(g), str(tmp_path / "c"))


def test_containers_and_writers(spark, tmp_path):
    from pyspark.sql import types as T

    el = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "l.json").write_text("[{\"a\": 1}]")
    (tmp_path / "o.json").write_text('{"samples": [{"a": 2}, {"a": 3}]}')
    assert [r["a"] for r in files.read_json_container(spark, str(tmp_path / "l.json"), el).collect()] == [1]
    assert [r["a"] for r in files.read_json_container(spark, str(tmp_path / "o.json"), el).collect()] == [2, 3]
    d = spark.createDataFrame([(1, "x,\n\"q\""), (2, None)], "a long, b string")
    assert files.write_parquet(d, str(tmp_path / "p"), rows=2) == 2
    with pytest.raises(ValueError):
        files.write_parquet(d, str(tmp_path / "p2"), rows=3)
    files.write_jsonl(d, str(tmp_path / "j"), files=1)
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["a"]) == [{"a": 1, "b": 'x,\n"q"'}, {"a": 2, "b": None}]
    files.write_routed(d, str(tmp_path / "r"), {"kept": F.col("a") == 1, "all": F.lit(True), "none": F.col("b") == "z"})
    assert [spark.read.parquet(str(tmp_path / "r" / n)).count() for n in ("kept", "all", "none")] == [1, 2, 0]
    files.append_csv(d.select("a"), str(tmp_path / "csv"))
    files.append_csv(d.select("a"), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "a long").count() == 4
    files.write_json(str(tmp_path / "m.json"), {"ü": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"ü": 1}
    assert files.first_readable(lambda: spark.read.parquet(str(tmp_path / "nope")), lambda: d).count() == 2
    assert files.file_digests(spark, str(tmp_path / "m.json")).first()["bytes"] == (tmp_path / "m.json").stat().st_size
    assert files.line_digests(spark, str(tmp_path / "j")).first()["lines"] == 2
    s = files.read_splits(spark, {"train": str(tmp_path / "p"), "val": str(tmp_path / "r" / "kept")}, rename={"b": "text"})
    assert s.columns == ["a", "text", "source_split"] and s.count() == 3
    assert "## 1" in files.preview(d, "a", "a", 1, ["b"])


def test_html(spark):
    page = "<html><body><p>intro</p>" + "<h2>Problem Tier 2</h2><p>" + "long text " * 80 + "</p><p>end</p></body></html>"
    d = spark.createDataFrame([(1, page), (2, page), (3, None), (4, "")], "k long, html string")
    got = files.html_chunks(d, "k", "html", "Problem").collect()
    assert len(got) == 1 and got[0]["tier"] == "2" and got[0]["k"] == 1


def test_paged(spark, tmp_path):
    for k in (0, 2, 4):
        rows = [{"row": {"a": i, "b": str(i)}} for i in range(k, min(k + 2, 5))]
        (tmp_path / f"{k}.json").write_text(json.dumps({"rows": rows}))
    paged.register(spark)
    d = spark.read.format("paged_rest").options(url=f"file://{tmp_path}/{{offset}}.json", total=5, page=2, schema="a int, b string").load()
    assert sorted((r["a"], r["b"]) for r in d.collect()) == [(i, str(i)) for i in range(5)]


def test_resumable(spark, tmp_path):
    items = spark.createDataFrame([(i,) for i in range(6)], "k long")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    work = lambda d: d.withColumn("status", F.when(F.col("k") % 2 == 0, "ok").otherwise("error")).withColumn("v", F.col("k") * 10)
    assert state.resumable_map(items, "k", work, out, log) == 6
    assert state.resumable_map(items, "k", lambda d: d.withColumn("status", F.lit("ok")).withColumn("v", F.col("k") * 10), out, log) == 3
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [0, 10, 20, 30, 40, 50]
    assert state.resumable_map(items, "k", work, out, log) == 0


def test_latest_stream(spark, tmp_path):
    src, t, c = str(tmp_path / "src"), str(tmp_path / "t"), str(tmp_path / "c")
    for part in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]):
        spark.createDataFrame(part, "k long, o long, v string").write.mode("append").parquet(src)
        state.latest(spark.readStream.schema("k long, o long, v string").parquet(src), "k", "o", ["v"], t, c).awaitTermination()
    assert {(r["k"], r["v"]) for r in state.read_latest(spark, t).collect()} == {(1, "c"), (2, "b")}


def test_stateful_streams(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.createDataFrame([("r", i, 0.1 * i, 1.0) for i in range(10)], "run string, step long, a double, b double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("run string, step long, a double, b double").parquet(src)
    q = state.gate_stream(stream, "run", "step", ["a", "b"], 3, 0.5).writeStream.format("memory").queryName("gate").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    got = {r["step"]: r["open"] for r in spark.table("gate").collect()}
    assert [got[i] for i in range(10)] == [i >= 6 for i in range(10)]
    q = state.bounded_queue(stream.select("run", "step", F.col("step").cast("string").alias("item")), "run", "item", "step", 4).writeStream.format("memory").queryName("queue").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    dropped = sorted(r["item"] for r in spark.table("queue").filter("event = 'dropped'").collect())
    assert dropped == [str(i) for i in range(6)]


def test_rounds_and_growth(spark, tmp_path):
    make = lambda k, have: spark.createDataFrame([(k * 2,), (k * 2 + 1,)], "k long")
    assert state.rounds(make, lambda d: d, str(tmp_path / "a"), spark, 5) == 6
    with pytest.raises(RuntimeError):
        state.rounds(make, lambda d: d.filter("k < 2"), str(tmp_path / "b"), spark, 5)
    g = state.GrowingTable(spark, str(tmp_path / "g"))
    assert g.read() is None
    g.on_batch_end(spark.range(2), lambda b: b)
    g.on_batch_end(spark.range(3), lambda b: b)
    assert g.read().count() == 5
