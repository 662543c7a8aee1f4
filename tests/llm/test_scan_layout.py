"""Results that do not depend on how a scan is split."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sensorgrid.llm import mixing, simhash
from sensorgrid.llm.common import PLACE, located

COLUMNS = "doc_id long, text string, source string"


@pytest.fixture
def files(spark, tmp_path):
    """A table in 8 files, and a way to split its scan otherwise."""
    rows = [(i, f"word{i} " * (1 + i % 7), f"s{i % 3}") for i in range(4000)]
    rows += [(None, f"word{i} and more", "s1") for i in range(50)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, COLUMNS).repartition(8).write.parquet(path)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def split(parts):  # as if so many cores were there when the scan is planned
        spark.conf.set("spark.sql.files.minPartitionNum", parts)

    yield path, split
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.set("spark.sql.files.openCostInBytes", old)


def test_places_do_not_depend_on_the_split(spark, files):
    path, split = files
    seen = []
    for parts in ("2", "6"):
        split(parts)
        frame = located(spark.read.parquet(path))
        seen.append((frame.rdd.getNumPartitions(), {
            (r.file, r.pos): tuple(r.row) for r in frame.select("row", *PLACE).collect()}))
    assert seen[0][0] != seen[1][0] and len(seen[0][1]) == 4050 and seen[0][1] == seen[1][1]


@pytest.mark.parametrize("before, after", [("2", "6"), ("6", "2")])
def test_rows_stay_right_when_the_split_changes(spark, files, before, after):
    path, split = files
    docs = spark.read.parquet(path)
    split(before)
    same = [Counter(map(tuple, f(docs).collect())) for f in (simhash.drop_near_copies, mixing.apply_mix)]
    split(before)
    frames = [f(docs) for f in (simhash.drop_near_copies, mixing.apply_mix)]
    split(after)
    assert [Counter(map(tuple, f.collect())) for f in frames] == same
    assert frames[1].agg(F.max("doc_id")).first()[0] is not None
