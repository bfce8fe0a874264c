"""A query over a growing folder gives what the batch query gives."""

from larkspur.expr import q, s
from larkspur.session import Engine
from larkspur.streaming.continuous import keep_table, run_available, stream_table


def test_stream_like_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    write = lambda a, b: spark.range(a, b).selectExpr("id", "id % 3 as k", "id * 2 as v").coalesce(1).write.mode("append").parquet(folder)
    write(0, 50)
    engine = Engine(spark)
    stream_table(engine, "numbers", folder)
    some = q.Select(q.Table(s.numbers), q.Where(q.Greater(s.v, 20)))
    sums = q.Group(q.Table(s.numbers), q.By(s.k), q.As(s.total, q.Sum(s.v)))
    for last in (50, 90):
        if last > 50:
            write(50, last)
        run_available(engine, some, str(tmp_path / "some"), str(tmp_path / "c1"))
        keep_table(engine, sums, str(tmp_path / "sums"), str(tmp_path / "c2"))
        assert spark.read.parquet(str(tmp_path / "some")).count() == sum(2 * i > 20 for i in range(last))
        got = {r.k: r.total for r in spark.read.parquet(str(tmp_path / "sums")).collect()}
        assert got == {k: sum(2 * i for i in range(last) if i % 3 == k) for k in range(3)}
