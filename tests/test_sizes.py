"""Work is dealt out by rows, not by the bytes of a small file; what a task holds is bounded."""

import pyarrow as pa

from weftline.batches import slices
from weftline.operators import features
from weftline.sources import dxf


def test_small_files_of_many_drawings_are_many_tasks(spark, tmp_path):
    spark.range(3 * 4096).selectExpr("id AS p_partkey", "1 AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert dxf._plates(spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_batches_are_cut():
    batch = pa.RecordBatch.from_pydict({"x": list(range(150))})
    assert [b.num_rows for b in slices(iter([batch, batch.slice(0, 0)]))] == [64, 64, 22]


def test_the_first_frames_of_a_spectrum(spark):
    """Frames handed on are those of the whole spectrum, silence included, and only these leave Python."""
    sounds = spark.createDataFrame([(1, [0.5, -0.5, 0.25] * 300), (2, []), (3, None)], "id long, xs array<double>")
    whole = features.log_mel(sounds).where("frame < 10").orderBy("id", "frame").collect()
    assert features.log_mel(sounds, 10).orderBy("id", "frame").collect() == whole and len(whole) == 30
