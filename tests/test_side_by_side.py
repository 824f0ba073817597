"""Jobs at the same time, each ended alone."""

import time

from quire.plans.benchmark import side_by_side


def slow(batches):
    time.sleep(3)
    yield from batches


def test_jobs_overlap_and_end_alone(spark):
    times = {}

    def job(name, fails=False):
        def run():
            began = time.monotonic()
            n = spark.range(4, numPartitions=1).mapInPandas(slow, "id long").count()
            times[name] = (began, time.monotonic())
            if fails:
                raise ValueError("no")
            return n

        return run

    def endless():
        while True:
            spark.range(1, numPartitions=1).mapInPandas(slow, "id long").count()

    found = side_by_side(spark, {"a": job("a"), "b:x": job("b:x"), "bad": job("bad", True), "late": endless}, seconds=25)
    assert found["a"] == found["b:x"] == 4
    assert isinstance(found["bad"], ValueError) and isinstance(found["late"], TimeoutError)
    assert max(b for b, _ in times.values()) < min(e for _, e in times.values())
    assert spark.range(3).count() == 3
