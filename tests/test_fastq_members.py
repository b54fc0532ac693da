"""Record files are made from one computation of the pairs, and read back by as many tasks as they have parts."""
import bz2
import gzip

import pytest
from pyspark.sql import functions as F
from test_restart import pairs

from contactforge.errors import ContactError
from contactforge.functions.sequence import phred
from contactforge.plans import queries
from contactforge.sinks import records
from contactforge.sources import fastq
from contactforge.storage import written


def test_quality_texts(spark):
    given = [[40] * 50, [2, 40, 2], [], None, [None], [7, None, 7], [7, None, 8], [0], [93, 93]]
    text = lambda q: None if q is None else "".join(chr(x + 33) for x in q if x is not None)
    rows = spark.createDataFrame(list(enumerate(given)), "k int, q array<int>")
    assert [r[0] for r in rows.orderBy("k").select(phred(F.col("q"))).collect()] == list(map(text, given))


def record(k, size=4):
    return f"@n:{k} x\n{'ACGT' * size}\n+\n{'IIII' * size}"


@pytest.mark.parametrize(("suffix", "pack"), [("gz", gzip.compress), ("bz2", bz2.compress), ("fq", bytes)])
def test_members_are_read_by_a_task_each(spark, tmp_path, suffix, pack):
    known = [record(k, k % 7) for k in range(5000)]  # some reads are empty
    text = lambda a, b: "".join(f"{r}\n" for r in known[a:b]).encode()
    parts = [pack(text(0, 1)), pack(b""), pack(text(1, 3000)) + pack(text(3000, 3001)), pack(text(3001, 5000))]
    path = tmp_path / f"a b.{suffix}"
    path.write_bytes(b"".join(parts))
    rows = fastq.read_records(spark, str(path), [len(p) for p in parts])
    assert rows.rdd.getNumPartitions() == len([p for p in parts if p])
    for found in (rows, fastq.read_records(spark, str(path)), fastq._scanned(spark, str(path))):
        assert [tuple(r) for r in found.orderBy("n").collect()] == list(enumerate(known, 1))
    with pytest.raises(ContactError, match="bytes"):
        fastq.read_records(spark, str(path), [1])


def test_records_across_blocks():
    known = [record(k, k % 5).encode() for k in range(40)]
    text = b"\n".join(known)
    for size in (1, 7, 64, 10**6):
        for end in (b"", b"\n"):
            whole = text + end
            got = fastq._whole(whole[i : i + size] for i in range(0, len(whole), size))
            assert [x for a in got for x in a.to_pylist()] == known
    assert not list(fastq._whole(iter([])))
    with pytest.raises(ContactError, match="four lines"):
        list(fastq._whole(iter([b"@a\nACGT\n"])))


def test_outputs_share_one_computation(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    def simple(*_):
        return pairs(spark.range(0, 300, 1, 3).select(F.col("id").alias("idx"))).withColumn("name1", F.udf(seen)(F.col("name1")))

    monkeypatch.setattr(queries, "_simple", simple)
    got = {}
    for r in queries.QUERIES["fastq_files"](spark, "").collect():
        got.setdefault(r.file, {})[r.n] = r.record
    assert made.value == 300
    one = lambda k, r: f"@n{r}:{k}\nACGT{k}\n+\nI"
    assert got["both"] == {2 * k + r: one(k, r) for k in range(300) for r in (1, 2)}
    assert all(got[f"r{r}"] == {k + 1: one(k, r) for k in range(300)} for r in (1, 2))


def test_repeated_pairs_stand_in_order_of_read(spark, tmp_path):
    numbers = spark.createDataFrame([(2,), (1,), (2,)], "idx long")
    held = written(records.texts(pairs(numbers)))
    sizes = records.write_texts(held, f"{tmp_path}/x.fq")
    names = [r.record.split("\n")[0] for r in fastq.read_records(spark, f"{tmp_path}/x.fq", sizes[f"{tmp_path}/x.fq"]).orderBy("n").collect()]
    assert names == ["@n1:1", "@n2:1", "@n1:2", "@n1:2", "@n2:2", "@n2:2"]
