"""The boundary is the first valid book after the freeze, written once, by one of several writers, and for one version."""

from concurrent.futures import ThreadPoolExecutor

from tapeframe.sources import boundary


def test_first_valid_book_after_the_freeze_is_kept(spark, tmp_path):
    folder = f"{tmp_path}/b"
    books = spark.createDataFrame([(k * 1000, 100 + k) for k in range(20)], "at long, last_id long").repartition(3)
    assert boundary.boundary(spark, folder, "v1", books) is None, "no freeze, no boundary"
    assert boundary.freeze(spark, folder, "v1", 5000)["frozenAtMs"] == 5000
    assert boundary.freeze(spark, folder, "v1", 9000)["frozenAtMs"] == 5000, "a second freeze changes nothing"
    assert boundary.boundary(spark, folder, "v1", books.where("at <= 5000")) is None, "no valid book yet"
    first = boundary.boundary(spark, folder, "v1", books)
    assert (first["startedAtMs"], first["lastUpdateId"]) == (6000, 106)
    assert boundary.boundary(spark, folder, "v1", books.where("at > 12000")) == first, "a second run changes nothing"
    assert boundary.boundary(spark, folder, "v2", books) is None, "another version inherits nothing"
    boundary.freeze(spark, folder, "v2", 11_000)
    assert boundary.boundary(spark, folder, "v2", books)["startedAtMs"] == 12_000


def test_of_several_writers_one_wins(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda k: boundary.create(spark, f"{tmp_path}/m.json", {"writer": k}), range(8)))
    assert len({f["writer"] for f in found}) == 1


def test_phases(spark):
    valid = spark.createDataFrame([("A", 10), ("A", 30), ("B", 5)], "symbol string, at long")
    first = boundary.first_after(valid, ["symbol"], 8)
    rows = valid.join(first, "symbol", "left").select("symbol", "at", boundary.phase(valid["at"], first["boundary"]).alias("phase"))
    assert {(r.symbol, r.at): r.phase for r in rows.collect()} == {("A", 10): "prospective", ("A", 30): "prospective", ("B", 5): "warmup"}
