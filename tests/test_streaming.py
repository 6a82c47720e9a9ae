import datetime as dt

from strandloom.streaming.completeness import completed_reads


def test_reads_leave_when_complete_or_late(spark, tmp_path):
    start = dt.datetime(2020, 1, 1)
    schema = "read_id string, patch_idx int, total_patches int, ts timestamp"
    at = lambda m: start + dt.timedelta(minutes=m)
    parts = [[("a", 0, 2, at(0)), ("b", 0, 3, at(0))], [("a", 1, 2, at(1)), ("a", 1, 2, at(1))], [("a", 0, 2, at(2)), ("c", 0, 2, at(2))], [("z", 0, 1, at(120))], [("z2", 0, 1, at(240))], [("z3", 0, 1, at(360))]]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        f = next((tmp_path / f"p{i}").glob("*.parquet"))
        f.rename(folder / f"{i}.parquet")
        import os
        os.utime(folder / f"{i}.parquet", (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = completed_reads(stream).writeStream.format("memory").queryName("done").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    rows = spark.table("done").collect()
    got = {r.read_id: (r.got, r.expected, r.complete) for r in rows}
    assert sorted(r.read_id for r in rows).count("a") == 1 and len(rows) == len(got)
    assert got["a"] == (2, 2, True) and got["b"] == (1, 3, False) and got["c"] == (1, 2, False) and got["z"] == (1, 1, True)
