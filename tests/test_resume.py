"""Fetching that is stopped half-way, and goes on."""

import pytest

from ledgerlight.streaming.resume import ResumableFetch


def roster(spark, path, *keys):
    spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.mode("append").parquet(path)


def held(run):
    return sorted((r.key, r.batch, r.error) for r in run.outcomes().collect())


def test_each_key_once_however_often_it_is_stopped(spark, tmp_path):
    path, at = str(tmp_path / "out"), str(tmp_path / "roster")
    roster(spark, at, "a", "b", "b", None)
    roster(spark, at, "b", "c", "bad")
    roster(spark, at, "c", "d", "bad")
    stopped = []

    def fetch(key):
        if key.startswith("bad"):
            raise OSError(key)
        return key.encode()

    class Stopped(ResumableFetch):
        def store(self, batch, batch_id):
            if batch_id == 1 and len(stopped) == 0:  # before anything of the batch is stored
                stopped.append("before")
                raise RuntimeError("stopped")
            super().store(batch, batch_id)
            if batch_id == 1 and len(stopped) == 1:  # when all of it is stored
                stopped.append("after")
                raise RuntimeError("stopped")

    run = Stopped(spark, at, path, fetch)
    for _ in range(2):
        with pytest.raises(Exception, match="stopped"):
            run.run()
    run.run()
    assert held(run) == [("a", 0, None), ("b", 0, None), ("bad", 1, "OSError: bad"), ("bad", 2, "OSError: bad"), ("c", 1, None), ("d", 2, None)]
    assert sorted(map(tuple, run.records().select("batch", "named", "passed_over", "fetched", "failed").collect())) == [(0, 2, 0, 2, 0), (1, 3, 1, 1, 1), (2, 3, 1, 1, 1)]
    run.run()  # nothing new
    roster(spark, at, "a", "e")
    run.run()
    assert held(run)[-1] == ("e", 3, None) and len(held(run)) == 7
