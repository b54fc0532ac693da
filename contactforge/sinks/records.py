"""FASTQ and FASTA records, profile tables and TOML."""
from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContactError
from ..functions.sequence import phred
from ..sources.profile import table_rows
from ..storage import written

SUFFIXES = {".fq": "fastq", ".fastq": "fastq", ".fa": "fasta", ".fasta": "fasta"}
CODECS = {".gz": "gzip", ".bz2": "bzip2"}


def output_kind(first: str, second: str | None = None) -> tuple[str, str]:
    """('fastq' or 'fasta', codec) from the file names; both must say the same."""
    found = []
    for name in (first, second):
        if name is None:
            continue
        codec = next((c for s, c in CODECS.items() if name.endswith(s)), "none")
        bare = name.rsplit(".", 1)[0] if codec != "none" else name
        kind = next((k for s, k in SUFFIXES.items() if bare.endswith(s)), None)
        if kind is None:
            raise ContactError(f"unknown suffix: {name}")
        found.append((kind, codec))
    if len(set(found)) > 1:
        raise ContactError("both outputs need the same suffix")
    return found[0]


def fastq(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), name), seq, F.lit("+"), phred(qual))


def fasta(name: Column, seq: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(">"), name), seq)


def records(pairs: DataFrame, kind: str = "fastq") -> DataFrame:
    """(idx, r1r2, record): two rows a pair."""
    one = lambda r: F.struct(F.lit(r).alias("r1r2"), (fastq(F.col(f"name{r}"), F.col(f"seq{r}"), F.col(f"qual{r}")) if kind == "fastq" else fasta(F.col(f"name{r}"), F.col(f"seq{r}"))).alias("record"))
    return pairs.select("idx", F.explode(F.array(one(1), one(2))).alias("r")).select("idx", "r.r1r2", "r.record")


#: Bytes that a task holds of a part while it copies it.
BLOCK = 1 << 20


def _placed(target: str):
    """Copies whole part files to their places in the target; a repeated task writes the same bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                done, out = 0, os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    with open(source, "rb") as f:
                        while done < size and (data := f.read(min(BLOCK, size - done))):
                            done += os.pwrite(out, data, at + done)
                            f.seek(done)
                    os.fsync(out)
                finally:
                    os.close(out)
                yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["written"])

    return run


def parts_of(spark: SparkSession, folder: str) -> list:
    """The file system's entries of a folder's part files, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return sorted((s for s in found if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())


def joined_parts(spark: SparkSession, folder: str, path: str) -> str:
    """The part files of a folder as one file, in order; the folder goes."""
    way = joined(spark, [folder], path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return way


def joined(spark: SparkSession, folders: list[str], path: str) -> str:
    """The part files of some folders, in order, as one file; ``concat`` takes them away, else they stay. Members of gzip and bzip2 files may follow each
    other. Says how it was done, none of it with the parts' bytes on the driver if the store allows:

    ``places``: in a file system that driver and executors mount, tasks write each part at its own offset (the sum of the
    sizes before it) of a file that is then renamed. ``concat``: a store that can join files' blocks does so. ``stream``:
    other stores know neither, so the driver copies the parts block by block.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    target = hadoop.fs.Path(path)
    fs, to = hadoop.fs.Path(folders[0]).getFileSystem(conf), target.getFileSystem(conf)
    parts = [p for f in folders for p in parts_of(spark, f)]
    sizes = [s.getLen() for s in parts]
    local = lambda p: unquote(p.toUri().getRawPath())
    if fs.getScheme() == to.getScheme() == "file":
        beside = hadoop.fs.Path(f"{path}.joining")
        to.delete(beside, True)
        to.create(beside, True).close()
        to.delete(hadoop.fs.Path(beside.getParent(), f".{beside.getName()}.crc"), False)
        if parts:
            places = spark.createDataFrame([(local(s.getPath()), at, n) for s, at, n in zip(parts, [0, *accumulate(sizes)], sizes, strict=False)], "source string, at long, size long")
            copied = places.repartition(len(parts), "at").mapInArrow(_placed(local(to.makeQualified(beside))), "written long").agg(F.sum("written")).first()[0]
            if copied != sum(sizes):
                raise ContactError(f"{copied} of {sum(sizes)} bytes were joined")
        to.delete(target, True)
        to.rename(beside, target)
        way = "places"
    elif parts and fs.getUri() == to.getUri() and fs.getScheme() in ("hdfs", "webhdfs"):
        to.delete(target, True)
        full = [s.getPath() for s in parts if s.getLen()] or [parts[0].getPath()]
        fs.rename(full[0], target)
        if len(full) > 1:
            rest = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(full) - 1)
            for i, p in enumerate(full[1:]):
                rest[i] = p
            fs.concat(target, rest)
        way = "concat"
    else:
        to.delete(target, True)
        out = to.create(target, True)
        try:
            for s in parts:
                read = fs.open(s.getPath())
                hadoop.io.IOUtils.copyBytes(read, out, BLOCK, False)
                read.close()
        finally:
            out.close()
        way = "stream"
    return way


def texts(pairs: DataFrame, kind: str = "fastq") -> DataFrame:
    """record1 and record2 in place of the reads' names, bases and qualities: a text is made once for all outputs."""
    made = {f"record{r}": fastq(F.col(f"name{r}"), F.col(f"seq{r}"), F.col(f"qual{r}")) if kind == "fastq" else fasta(F.col(f"name{r}"), F.col(f"seq{r}")) for r in (1, 2)}
    return pairs.withColumns(made).drop(*(f"{c}{r}" for c in ("name", "seq", "qual") for r in (1, 2)))


def write_texts(held: DataFrame, first: str, second: str | None = None, one_file: bool = True) -> dict[str, list[int]]:
    """A written table of ``texts`` interleaved into one output, or R1 and R2 into two, in order of pair number, sorted by
    ranges of it. Returns the bytes of each output's parts in their order, where ``one_file`` has joined them: every part is a
    whole number of records, compressed on its own."""
    spark, codec, sizes = held.sparkSession, output_kind(first, second)[1], {}
    one = lambda r: F.struct(F.lit(r).alias("r1r2"), F.col(f"record{r}").alias("record"))
    both = held.select("idx", F.explode(F.array(one(1), one(2))).alias("r")).select("idx", "r.r1r2", "r.record")
    # One read of a pair is read from the table as a column; the other one isn't touched.
    outputs = [(first, both)] if second is None else [(p, held.select("idx", F.lit(r).alias("r1r2"), F.col(f"record{r}").alias("record"))) for r, p in ((1, first), (2, second))]
    for path, rows in outputs:
        folder = f"{path}.parts" if one_file else path
        rows.orderBy("idx", "r1r2").select("record").write.mode("overwrite").option("compression", codec).text(folder)
        if one_file:
            sizes[path] = [s.getLen() for s in parts_of(spark, folder)]
            joined_parts(spark, folder, path)
    return sizes


def write_reads(pairs: DataFrame, first: str, second: str | None = None, one_file: bool = True) -> DataFrame:
    """Interleaved into one output, or R1 and R2 into two, in order of pair number.

    The pairs are computed once and written to the shared folder with their records; outputs are sorted from there by
    ranges of pair numbers. ``one_file`` joins the parts of an output (else it is a folder of them). Returns the written
    pairs, which the caller may summarise and must remove.
    """
    held = written(texts(pairs, output_kind(first, second)[0]))
    write_texts(held, first, second, one_file)
    return held


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_profile(profile: DataFrame, path: str, ordered: bool = True, overwrite: bool = False) -> None:
    """The profile as one text file, in order of cell, molecule and segment; an existing one is kept unless told
    otherwise. Rows are names, so that their number is small beside the sequences'."""
    spark = profile.sparkSession
    if exists(spark, path) and not overwrite:
        raise ContactError(f"{path} exists already")
    rows = table_rows(profile)
    head = spark.createDataFrame([("#chrom\tcell\tmolecule\tabundance\tcopy_number", "", 0)], "line string, ord string, k int")
    rows = head.unionByName(rows.select("line", F.col("ord") if ordered else F.lit("").alias("ord"), F.lit(1).alias("k"))).orderBy("k", "ord")
    rows.select("line").write.mode("overwrite").text(f"{path}.parts")
    joined_parts(spark, f"{path}.parts", path)


def toml_lines(segments: DataFrame) -> DataFrame:
    """(cell, repl, seg_id, value): a line of TOML for each segment, with the headings before the first one of a cell and
    a replicon, and the end of the list after the last one. Where lists begin and end is counted, not gathered: no row or
    task holds a replicon, however many segments it has."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    rows = segments.select("cell", "repl", "seg_id", "abundance", "copy_number").dropDuplicates(["cell", "repl", "seg_id"])
    repls = rows.groupBy("cell", "repl").agg(F.min("seg_id").alias("first"), F.max("seg_id").alias("last"), F.min("copy_number").alias("copies"), F.min("abundance").alias("share"))
    cells = repls.groupBy("cell").agg(F.min("repl").alias("first_repl"), F.min("share").alias("share"))
    every = rows.select("cell", "repl", "seg_id").join(repls.drop("share").join(cells, "cell"), ["cell", "repl"])
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    opens = F.col("seg_id") == F.col("first")
    cell = F.when(opens & (F.col("repl") == F.col("first_repl")), text("\n[[community.cells]]\nname = ", quoted(F.col("cell")), "\nabundance = ", F.col("share").cast("string"), "\n"))
    repl = F.when(opens, text("\n[[community.cells.replicons]]\nname = ", quoted(F.col("repl")), "\ncopy_number = ", F.col("copies").cast("string"), "\nsegments = [\n"))
    value = text(F.coalesce(cell, F.lit("")), F.coalesce(repl, F.lit("")), "  ", quoted(F.col("seg_id")), ",", F.when(F.col("seg_id") == F.col("last"), "\n]").otherwise(""))
    return every.select("cell", "repl", "seg_id", value.alias("value"))


def write_toml(segments: DataFrame, path: str, spurious_rate: float | None = None) -> None:
    """The community as one TOML file in order of cell, replicon and segment, sorted by ranges and joined by tasks."""
    spark = segments.sparkSession
    head = 'profile_version = "1"\n\n[community]' + ("" if spurious_rate is None else f"\nspurious_rate = {spurious_rate}")
    first = spark.createDataFrame([(0, "", "", "", head)], "k int, cell string, repl string, seg_id string, value string")
    rows = first.unionByName(toml_lines(segments).withColumn("k", F.lit(1))).orderBy("k", "cell", "repl", "seg_id")
    rows.select("value").write.mode("overwrite").text(f"{path}.parts")
    joined_parts(spark, f"{path}.parts", path)
