"""An audited scan: edges and counts of one pass over a CSV."""

import pytest
from pyspark.sql import Observation

from marquetry.functions.contracts import ContractError
from marquetry.operators import interactions

HEADER = "user_id,item_id,playtime_forever,playtime_2weeks\n"


def csv(tmp_path, *parts):
    folder = tmp_path / "source"
    folder.mkdir()
    for k, part in enumerate(parts):
        (folder / f"part{k}.csv").write_text(HEADER + part)
    return str(folder)


def test_scan_equals_two_passes(spark, tmp_path):
    path = csv(tmp_path, "1,10,5,\n1,10,2,7\n,10,1,1\nNA,10,1,1\n", "2,011,1,1\n2,,1,1\n03,,1,1\n2,9223372036854775807,0,-0.0\n2,9223372036854775808,0,0\n")
    edges, audit = interactions.audited_scan(spark, path)
    assert sorted(map(tuple, edges.select("user_id", "item_id", "playtime_forever", "playtime_2weeks").collect())) == [(1, 10, 5.0, 7.0), (2, 2**63 - 1, 0.0, 0.0)]
    text = spark.read.schema("user_id string, item_id string, playtime_forever double, playtime_2weeks double").csv(path, header=True)
    want, counted = interactions.load_interactions(text)
    assert audit.collect() == counted.collect() and sorted(edges.collect()) == sorted(want.select(*edges.columns).collect())
    assert audit.first()["source_rows"] == 9 and audit.first()["eligible_rows"] == 3


def test_the_source_is_read_once(spark, tmp_path, monkeypatch):
    path, made = csv(tmp_path, "1,10,5,1\n"), []
    real = Observation.__init__
    monkeypatch.setattr(Observation, "__init__", lambda self, *a: made.append(1) or real(self, *a))
    edges, audit = interactions.audited_scan(spark, path)
    (tmp_path / "source" / "part0.csv").unlink()
    assert edges.count() == 1 and audit.first()["source_rows"] == 1 and made == [1]


@pytest.mark.parametrize(("part", "words"), [
    ("1,2,3\n", "1 do not fit the columns, 0 have bad playtimes; the first: '1,2,3'"),
    ("1,2,3,4,5\n1,2,3,4\n", "1 do not fit"),
    ("1,2,many,4\n", "first: '1,2,many,4'"),
    ("1,2,-1,4\nx,2,NaN,4\n", "0 do not fit the columns, 2 have bad playtimes; the first: '1,2,-1.0,4.0'"),
])
def test_broken_lines_are_errors_with_the_line(spark, tmp_path, part, words):
    with pytest.raises(ContractError, match="of .* rows") as found:
        interactions.audited_scan(spark, csv(tmp_path, part))
    assert words in str(found.value)


def test_empty_and_wrong_headers(spark, tmp_path):
    edges, audit = interactions.audited_scan(spark, csv(tmp_path, ""))
    assert edges.count() == 0 and set(audit.first()) == {0}
    other = tmp_path / "other.csv"
    other.write_text("item_id,user_id,playtime_forever,playtime_2weeks\n1,2,3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        interactions.audited_scan(spark, str(other))
