"""Files of the nearest-neighbour query where the session asks for many more partitions than rows fill."""

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import _util, ann


def test_few_vectors_fill_few_files(spark, tmp_path, monkeypatch):
    v = np.random.default_rng(3).normal(size=(200, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "vectors"))
    made, path_of = [], _util.new_path
    monkeypatch.setattr(_util, "new_path", lambda *a: made.append(path_of(*a)) or made[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ann.nearest(spark.read.parquet(str(tmp_path / "vectors")), F.col("vec_id") % 20 == 0, block=60).write.parquet(str(tmp_path / "out"))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    # each file costs an executor several processes; a task a core and block at least
    cores = spark.sparkContext.defaultParallelism
    files = [len(spark.read.parquet(p).inputFiles()) for p in (made[0], str(tmp_path / "out"))]
    assert len(made) == 1 and files[0] <= cores and files[1] <= max(cores, 4)
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    near = {i: sorted((-ann.exact_score(v[i], w), j) for j, w in enumerate(v) if j != i)[:20] for i in range(0, 200, 20)}
    assert got == {i: [j for _, j in x] for i, x in near.items()}


def test_tasks_follow_the_input(spark, tmp_path, monkeypatch):
    path, cores = str(tmp_path / "rows"), spark.sparkContext.defaultParallelism
    spark.range(100_000).write.parquet(path)
    rows = spark.read.parquet(path)
    assert _util.tasks_for(rows) == cores
    monkeypatch.setattr(_util, "TASK_BYTES", 1000)
    assert _util.tasks_for(rows, 3) == 3 * _util.tasks_for(rows) > 300
    # of rows of unknown size Spark's estimate is huge
    assert _util.tasks_for(spark.createDataFrame([(1,)], "a int").union(rows.limit(0).selectExpr("int(id)")), 9) <= 2**31 - 1
