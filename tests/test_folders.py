"""Streams read a table that is a folder of files like one that is a file."""

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def folders(spark, path, change):
    for name in ("events", "labels"):
        change(spark.read.parquet(f"{DIR}/{name}.parquet")).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_stream_of_a_folder(spark, tmp_path):
    states = entry.queries()["st_review_states"]
    want = sorted(map(tuple, states(spark, DIR).collect()))
    assert want and sorted(map(tuple, states(spark, folders(spark, tmp_path, lambda d: d.repartition(3))).collect())) == want


def test_stream_of_an_empty_table(spark, tmp_path):
    assert entry.queries()["st_review_states"](spark, folders(spark, tmp_path, lambda d: d.limit(0))).count() == 0


def test_transcripts_make_no_folder_each(spark):
    """the files of `src_artifacts` follow the partitions, not the recordings."""
    from pathlib import Path

    from clipmine import catalog
    from clipmine.session import shared_dir

    catalog.load_all()
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("transcripts-*"))
    out = catalog.QUERIES["src_artifacts"](spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()
    (new,) = set(folder.glob("transcripts-*")) - before
    assert len([p for p in new.rglob("*.json")]) <= 4 and not [p for p in new.iterdir() if p.is_dir()]
