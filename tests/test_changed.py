import os

from textloom.plans import queries as base
from textloom.sources import versions
from textloom.streaming.changed import extract_changed


def _put(path, data: bytes, time: int):
    path.write_bytes(data)
    os.utime(path, (time, time))


def test_each_version_of_a_file_is_given_once(spark, tmp_path):
    top = tmp_path / "in"
    (top / "d").mkdir(parents=True)
    texts = lambda: sorted((r.path.rpartition("/in/")[2], r.version, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    def run():
        extract_changed(spark, str(top), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return texts()

    _put(top / "a.txt", b"one", 1000)
    _put(top / "d" / "b.html", b"<p>b", 1010)
    _put(top / ".hidden", b"x", 1010)
    first = [("a.txt", 1, "one"), ("d/b.html", 1, "b")]
    assert run() == first
    assert run() == first  # nothing new
    _put(top / "a.txt", b"two", 1020)
    _put(top / "late.txt", b"late", 990)  # dated back, within the slack
    second = sorted([*first, ("a.txt", 2, "two"), ("late.txt", 1, "late")])
    assert run() == second
    _put(top / "a.txt", b"three", 2000)
    _put(top / "d" / "b.html", b"<p>longer", 1010)  # the same time, within the slack of the offset before
    _put(top / "late.txt", b"later", 1990)
    assert run() == sorted([*second, ("a.txt", 3, "three"), ("d/b.html", 2, "longer"), ("late.txt", 2, "later")])
    plain = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in plain


def test_listing_and_versions_that_are_gone(tmp_path):
    assert list(versions.listed(f"{tmp_path}/none")) == []
    _put(tmp_path / "a.txt", b"one", 1000)
    (path, time, size), = versions.listed(str(tmp_path))
    assert (path, time, size) == (f"{tmp_path}/a.txt", 1_000_000_000, 3)
    import datetime

    at = datetime.datetime.fromtimestamp(1000, datetime.UTC)
    assert versions.content_of(path, at) == b"one"
    assert versions.content_of(path, at + datetime.timedelta(seconds=1)) is None
    assert versions.content_of(f"{tmp_path}/none.txt", at) is None


def test_offsets_move_with_the_slack_window(tmp_path):
    reader = versions._Reader(str(tmp_path), 60, 1)
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    _put(tmp_path / "a.txt", b"one", 1000)
    one = reader.latestOffset()
    _put(tmp_path / "b.txt", b"b", 950)
    two = reader.latestOffset()
    assert one["time"] == two["time"] and one != two
    assert [p.files[0][0].rpartition("/")[2] for p in reader.partitions(one, two)] == ["a.txt", "b.txt"]
    _put(tmp_path / "c.txt", b"c", 900)  # beyond the slack: not seen
    assert reader.latestOffset() == two


def test_changed_files_over_empty_tables(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert base.QUERIES["changed_files"](spark, str(tmp_path)).count() == 0
