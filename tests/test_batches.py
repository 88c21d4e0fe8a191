"""Python workers get and make bounded pieces, however large a task's share is."""

import pyarrow as pa
from pyspark.sql import functions as F

from spindrift.functions import html
from spindrift.session import BATCH, PIECE, over_batches, pieces, ship


def test_pieces():
    for values in (pa.array([], pa.string()), pa.array(["x" * (3 * PIECE), "y", None]), pa.array(["ab" * 500] * 4_000 + [None])):
        parts = list(pieces(values))
        assert pa.concat_arrays(parts).equals(values)
        assert all(p.nbytes <= 2 * PIECE or len(p) == 1 for p in parts) and parts


def test_workers_get_small_batches(spark):
    """20 MB of text in one task: before, one batch of 10,000 rows was made of half of it."""
    ship(spark)
    rows = spark.range(10_000, numPartitions=1).select(F.repeat(F.lit("x"), 2_000).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 2 * BATCH


def test_a_bound_of_the_session_is_kept(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, "12345b")
        ship(spark)
        assert spark.conf.get(name) == "12345b"
    finally:
        spark.conf.set(name, old)


def test_values_across_pieces(spark):
    ship(spark)
    texts = ["<p>" + "é" * n + "</p>" for n in (0, 1, 900_000, 5, 2_000_000)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = rows.select("i", over_batches(len, "int")("t").alias("n"), html.html_text(F.col("t")).alias("h")).orderBy("i").collect()
    assert [r.n for r in got] == [None if t is None else len(t) for t in texts]
    assert [r.h for r in got] == ["" if t is None else t[3:-4] for t in texts]
