"""Two-level running sums against plain ones."""
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from contactforge.operators import prefix


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_running_sums(spark, ranges):
    r = random.Random(ranges)
    rows = [(i, r.choice("abc"), r.choice([None, r.randrange(-5, 10**9)]), [i]) for i in range(700)]
    df = spark.createDataFrame(rows, "key long, name string, w long, other array<long>").repartition(6)
    got = prefix.running(df, [F.col("name").desc(), "key"], {"upto": "w", "n": None}, ranges).collect()
    want = sorted(rows, key=lambda x: (-ord(x[1]), x[0]))
    sums = list(accumulate(x[2] or 0 for x in want))
    assert {(x.key, x.name, x.w, tuple(x.other), x.upto, x.n) for x in got} == {(*x[:3], tuple(x[3]), s, i + 1) for i, (x, s) in enumerate(zip(want, sums, strict=True))}


def test_empty_tied_and_large(spark):
    empty = prefix.numbered(spark.range(0), ["id"])
    assert empty.count() == 0 and empty.columns == ["id", "n"]
    tied = prefix.numbered(spark.range(100).select((F.col("id") * 0).alias("k")), ["k"], ranges=7)
    assert sorted(r.n for r in tied.collect()) == list(range(1, 101))
    with pytest.raises(Exception, match="62 bits"):
        prefix.running(spark.range(8).select("id", F.lit(1 << 60).alias("w")), ["id"], {"s": "w"}, 1).count()


def test_plan_has_no_window(spark):
    plan = prefix.numbered(spark.range(1000), ["id"])._jdf.queryExecution().toString()
    assert "Window" not in plan
