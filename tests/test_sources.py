"""Readers, sinks, manifests and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquetry.functions.contracts import ContractError
from marquetry.sources import files, literal, matrices, scratch
from marquetry.streaming import edges as streams


def test_literal_lines(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("{u'user_id': u'20', 'steam_id': None, 'items': [{'item_id': 3, 'playtime_forever': 1}]}\n\n{'user_id': 'é', 'items': []}\n")
    rows = literal.read_literals(spark, str(path), literal.LIBRARY).collect()
    assert [r["user_id"] for r in rows] == ["20", "é"]
    assert rows[0]["items"][0]["item_id"] == "3" and rows[0]["items"][0]["playtime_forever"] == 1.0
    path.write_text("[1]\n__import__('os')\n{'user_id': 'x'}\n")
    got = literal.read_literals(spark, str(path), literal.LIBRARY, strict=False).collect()
    assert [r["user_id"] for r in got] == [None, None, "x"] and got[0]["_error"] and got[1]["_error"] and not got[2]["_error"]
    with pytest.raises(Exception, match="bad record"):
        literal.read_literals(spark, str(path), literal.LIBRARY).collect()


def test_csv_keeps_na_text(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("user_id,item_id,playtime_forever,playtime_2weeks\nNA,,1.5,0\n")
    r = files.read_csv(spark, str(path), files.INTERACTIONS, ["user_id", "item_id"]).first()
    assert r["user_id"] == "NA" and r["item_id"] is None
    assert files.inventory(spark, str(tmp_path)).count() == 1
    assert files.peek(spark, str(path)).first()["head"].startswith("user_id")


def test_publish_is_no_clobber_and_verified(spark, tmp_path):
    folder = str(tmp_path / "out")
    files.publish(spark, folder, {"a": spark.range(5).toDF("x")}, {"note": "n"})
    assert files.verify_published(spark, folder) == {"a": 5}
    with pytest.raises(FileExistsError):
        files.publish(spark, folder, {"a": spark.range(5).toDF("x")})
    spark.range(1).toDF("x").write.mode("append").parquet(f"{folder}/a")
    with pytest.raises(ContractError):
        files.load_published(spark, folder, "a")


def test_failed_publication_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    with pytest.raises(Exception, match="boom"):
        files.publish(spark, str(folder), {"a": spark.range(1).select(F.raise_error(F.lit("boom")).cast("int").alias("x"))})
    assert list(tmp_path.iterdir()) == []


def test_strict_json():
    assert files.load_json('{"a": 1}') == {"a": 1}
    for bad in ('{"a": 1, "a": 2}', "[1]", '{"a": NaN}'):
        with pytest.raises(ContractError):
            files.load_json(bad)
    assert files.redaction_leaks({"a": ["x", "/home/me/y"], "b": "me@x.org"}) == ["$.a[1]", "$.b"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, "2024-01-01 00:00:00", 7, "view", 1.0), (1, "2024-01-01 00:00:30", 7, "view", 1.0), (2, "2024-01-03 00:00:00", 8, "view", 3.0), (3, "2024-01-09 00:00:00", 8, "click", 3.0)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(source))
    stream = spark.readStream.schema(frame.schema).parquet(str(source))
    query = streams.write(streams.windowed_popularity(streams.distinct_events(stream), watermark=None), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(r["events"] == 1 for r in got)
    static = streams.running_edges(frame).collect()
    assert {(r["user_id"], r["item_id"]): r["playtime_forever"] for r in static}[7, "view"] == 1.0


def test_matrix_archives(spark, tmp_path):
    rows = [(u, i, float(u * i % 7 + 1)) for u in range(1, 30) for i in range(u % 4, 20, 3)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, value double")
    path = str(tmp_path / "m.npz")
    digest = matrices.write_csr(edges, path, "value")
    assert sorted(tuple(r) for r in matrices.read_csr(spark, path, {"m.npz": digest}).collect()) == sorted(rows)
    with np.load(path) as a:
        assert a["shape"].tolist() == [29, len({i for _, i, _ in rows})] and a["indptr"][-1] == len(rows)
    with pytest.raises(FileExistsError):
        matrices.write_csr(edges, path, "value")
    with pytest.raises(Exception, match="does not match"):
        matrices.read_csr(spark, path, {"m.npz": "0" * 64}).collect()
    factors = spark.createDataFrame([(3, [1.0, 2.0], 0.5), (1, [0.0, -1.0], 0.25)], "id long, vec array<float>, bias float")
    digest = matrices.write_factors(factors, str(tmp_path / "f.npz"))
    assert sorted(tuple(r) for r in matrices.read_factors(spark, str(tmp_path / "f.npz"), {"f.npz": digest}).collect()) == [(1, [0.0, -1.0], 0.25), (3, [1.0, 2.0], 0.5)]


def test_matrix_archives_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Archives of whole rows, several of them, and nothing collected as a frame."""
    monkeypatch.setattr(matrices, "EDGES_PER_ARCHIVE", 40)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("collected")))
    rows = [(u, i, float(u * i % 7 + 1)) for u in range(1, 60) for i in range(u % 4, 20, 3)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, value double")
    folder = str(tmp_path / "parts")
    digests = matrices.write_csr_parts(edges, folder, "value")
    assert len(digests) > 1 and sorted(tuple(r) for r in matrices.read_csr(spark, folder, digests).collect()) == sorted(rows)
    users = []
    for name in digests:
        with np.load(f"{folder}/{name}") as a:
            users += a["row_ids"].tolist()
            assert a["shape"].tolist() == [len(a["row_ids"]), len(a["column_ids"])]
    assert sorted(users) == list(range(1, 60))
    with pytest.raises(FileExistsError):
        matrices.write_csr_parts(edges, folder, "value")


def test_publication_after_a_crash(spark, tmp_path, monkeypatch):
    """A crash before the rename leaves nothing at the folder, so that the next try succeeds."""
    folder = str(tmp_path / "out")
    monkeypatch.setattr(files, "write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        files.publish(spark, folder, {"a": spark.range(5).toDF("x")})
    monkeypatch.undo()
    files.publish(spark, folder, {"a": spark.range(5).toDF("x")})
    assert files.verify_published(spark, folder) == {"a": 5}


def test_published_tables_follow_their_sources(spark, tmp_path):
    source, calls = str(tmp_path / "t.parquet"), []
    spark.range(3).write.parquet(source)

    def make():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 as twice")

    for _ in range(2):
        assert scratch.published(spark, "twice", [source], make).count() == 3
    spark.range(2).write.mode("append").parquet(source)
    assert scratch.published(spark, "twice", [source], make).count() == 5 and len(calls) == 2
