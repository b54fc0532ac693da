"""Sequence files as tiles, without a row that holds a sequence.

``SequenceFiles`` scans: Spark's text reader splits the files at any byte range, so the records of a split may begin before it
and end behind it. A first pass counts the bases between headers in each split; running sums over the splits tell whose
bases a split begins with, and where in the record they stand. A second pass cuts tiles as the lines go by; pieces of
a tile meet by (segment, tile).

``IndexedFiles`` looks up: an index of records (file, first and last byte, bases and bytes of a line) is made once and kept;
after that, only the bytes of the segments that are asked for are read, in ranges.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContactError, SequenceError
from ..functions.sequence import AMBIGUOUS
from ..operators import prefix
from ..operators.digest import TILE
from ..storage import removed, written
from ..store import Store, file_stamp

_UPPER = bytes(b - 32 if 97 <= b <= 122 else b for b in range(256))
_TO_N = bytes(ord("N") if chr(b) in AMBIGUOUS.upper() else b for b in range(256))
_BLANK = b" \t\r\n\v\f"
#: Bases that are cut into tiles at once.
CHUNK = 1 << 20
#: A split more is one small entry of the table that tells every task where its splits begin (some 100 MB at this bound).
MOST_SPLITS = 1 << 20
_RUNS = "file long, block long, k long, name string, n long"
#: Bytes of a file that one task searches for headers, and that one task reads of a segment.
RANGE = 32 << 20


def cleaned(data: bytes, convert: bool, validate: bool, name: str) -> bytes:
    """Upper-case symbols without blanks; ambiguous ones as N if wished, others refused if wished."""
    data = data.translate(_UPPER, _BLANK)
    if convert:
        data = data.translate(_TO_N)
    if validate and (rest := data.translate(None, b"ACGTN")):
        raise SequenceError(f"illegal symbols in sequence {name}: {rest[:20].decode(errors='replace')}")
    return data


def first_word(header: bytes) -> str:
    return (header.split(None, 1) or [b""])[0].decode()


PIECES = "seg_id string, tile int, at int, turn boolean, part string"


def pieces(name: str, start: int, text: bytes, overlap: int, tile: int) -> Iterator[tuple[str, int, int, bool, str]]:
    """What bases from ``start`` on give to each tile (with what overlaps it from behind)."""
    stop = start + len(text)
    for t in range(max(0, (start - tile - overlap) // tile + 1), (stop - 1) // tile + 1):
        low, high = max(start, t * tile), min(stop, (t + 1) * tile + overlap)
        if high > low:
            yield name, t, low - t * tile, False, text[low - start : high - start].decode()


def turned(name: str, n: int, start: int, text: bytes, overlap: int, tile: int) -> Iterator[tuple[str, int, int, bool, str]]:
    """What the same bases give to the last tiles of a circular sequence of ``n`` bases, which is read on from its
    beginning, once at most."""
    text = text[: max(0, overlap - start)]
    low, stop = n + start, n + start + len(text)
    for t in range(max(0, (low - tile - overlap) // tile + 1), (n - 1) // tile + 1):
        high = min(stop, (t + 1) * tile + overlap)
        if high > low:
            yield name, t, low - t * tile, True, text[: high - low].decode()


def joined_pieces(found: DataFrame, lengths: DataFrame, tile: int) -> DataFrame:
    """(seg_id, linear, length, tile, part) as ``digest.tiles`` gives them, from pieces and (seg_id, linear, length). Pieces are
    made once and meet in their tile only, as does an empty one that brings the segment's shape there: no task has a whole
    segment, and no lookup goes through the driver. Pieces of segments without a length are left out."""
    count = F.sequence(F.lit(0), F.floor((F.col("length") - 1) / tile).cast("int"))
    shapes = lengths.where("length > 0").select("seg_id", F.explode(count).alias("tile"), F.lit(-1).alias("at"), F.lit(False).alias("turn"), F.lit("").alias("part"), "linear", "length")
    every = found.select("seg_id", "tile", "at", "turn", "part", F.lit(None).cast("boolean").alias("linear"), F.lit(None).cast("int").alias("length")).unionByName(shapes)
    held = every.groupBy("seg_id", "tile").agg(F.max("linear").alias("linear"), F.max("length").alias("length"), F.collect_list(F.struct("at", "turn", "part")).alias("held")).where("length IS NOT NULL")
    mine = F.filter(F.array_sort("held"), lambda p: ~p["turn"] | ~F.col("linear"))
    return held.select("seg_id", "linear", "length", "tile", F.array_join(F.transform(mine, lambda p: p["part"]), "").alias("part"))


class SequenceFiles:
    """Files of records, read by scans that split them anywhere.

    A record begins with ``>`` at the start of a line, its name goes up to the first blank. Lines are rows, so that one line may
    have 2 GB; a record may have any number of lines (positions are 32 bits, 2^31 bases). Compressed files are one split
    each. Bases before a file's first header, and names that are repeated, are errors.
    """

    def __init__(self, spark: SparkSession, path: str, convert: bool = False, validate: bool = True):
        self.spark, self.path, self.convert, self.validate = spark, path, convert, validate
        self._runs: DataFrame | None = None
        self._lengths: DataFrame | None = None

    @property
    def stamp(self) -> str:
        return file_stamp(self.spark, self.path, "fasta", self.convert, self.validate)

    def _lines(self) -> DataFrame:
        # A split is known by numbers: eight bytes instead of a path beside each line.
        return self.spark.read.text(self.path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    @staticmethod
    def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes | None, bytes]]:
        """(split, header line or None, bases as they stand) in order: lines between headers in pieces of a batch or less."""
        for b in batches:
            if not b.num_rows:
                continue
            file, block, lines = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary())
            heads = pc.starts_with(lines, b">").to_numpy(zero_copy_only=False)
            turns = np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]
            starts = np.flatnonzero(heads | turns)
            values = lines.to_pylist()
            for s, e in zip(starts, [*starts[1:], len(values)], strict=True):
                head = values[s] if heads[s] else None
                yield (int(file[s]), int(block[s])), head, b"".join(values[s + (head is not None) : e])

    def _counted(self):
        """For each split, its stretches of bases between headers: number in the split, name (null before the first), bases."""
        convert, validate, stretches = self.convert, self.validate, self._stretches

        def run(batches):
            split, k, name, n = None, 0, None, 0
            for at, head, text in stretches(batches):
                if at != split or head is not None:
                    if split is not None:
                        yield *split, k, name, n
                    split, k, name, n = at, (k + 1 if at == split else int(head is not None)), None if head is None else first_word(head[1:]), 0
                n += len(cleaned(text, convert, validate, name or "?"))
            if split is not None:
                yield *split, k, name, n

        return run

    def runs(self) -> DataFrame:
        """(file, block, k, seg_id, at, n): every stretch of bases with its record and the place where it begins there."""
        if self._runs is None:
            # Written first: ranges are sampled, so that the files would be read for it once more.
            counted = written(self._lines().mapInArrow(_batched(self._counted(), _RUNS), _RUNS))
            placed = prefix.running(counted.withColumn("head", F.col("name").isNotNull().cast("long")), ["file", "block", "k"], {"upto": "n", "record": "head"})
            removed(counted)
            if placed.where("name IS NULL AND block = 0 AND n > 0").limit(1).count():
                raise SequenceError("bases before the first header of a file")
            own = placed.where("name IS NOT NULL").select("record", F.col("name").alias("seg_id"), (F.col("upto") - F.col("n")).alias("base"))
            self._runs = written(placed.join(own.hint("merge"), "record").select("file", "block", "k", "seg_id", "record", (F.col("upto") - F.col("n") - F.col("base")).alias("at"), "n"))
        return self._runs

    def lengths(self) -> DataFrame:
        """(seg_id, length) of each record; SequenceError if a name is repeated or there is none."""
        each = self.runs().groupBy("record", "seg_id").agg(F.sum("n").alias("length"))
        again = each.groupBy("seg_id").agg(F.count("*").alias("k"), F.max("length").alias("most")).where(f"k > 1 OR most >= {1 << 31}").limit(5).collect()
        if again:
            raise SequenceError("repeated names or too long: " + ", ".join(r[0] for r in again))
        if not self.runs().limit(1).count():
            raise SequenceError("no sequences")
        return each.select("seg_id", F.col("length").cast("int").alias("length"))

    def tiles(self, segments: DataFrame, overlap: int, tile: int = TILE) -> DataFrame:
        """(seg_id, linear, length, tile, part) of the segments (seg_id, linear)."""
        # Where each split begins, and how long the record is that it ends with: one row a split, behind a check of their number.
        runs = self.runs()
        splits = runs.groupBy("file", "block").agg(F.max(F.when(F.col("k") == 0, F.struct("seg_id", "at"))).alias("first"), F.max("record").alias("record"))
        sizes = runs.groupBy("record").agg(F.sum("n").alias("size"))
        first = splits.join(sizes.hint("merge"), "record").select("file", "block", "first", "size").limit(MOST_SPLITS + 1).collect()
        if len(first) > MOST_SPLITS:
            raise ContactError("too many splits: raise spark.sql.files.maxPartitionBytes")
        shared = self.spark.sparkContext.broadcast({(r["file"], r["block"]): (*(r["first"] or (None, 0)), r["size"]) for r in first})
        convert, validate, stretches = self.convert, self.validate, self._stretches

        def run(batches):
            split, name, at, held, size, heads = None, None, 0, [], 0, []

            def cut():
                text = b"".join(held)
                if at < overlap:
                    heads.append((at, text[: overlap - at]))
                return pieces(name, at, text, overlap, tile)

            def ends(n):
                return (p for start, text in heads for p in turned(name, n, start, text, overlap, tile))

            for now, head, text in stretches(batches):
                if now != split or head is not None:
                    if name is not None:
                        yield from cut()
                        # A record that ends before the split does is known up to its end.
                        yield from ends(at + size if now == split else shared.value[split][2])
                    held, size, heads = [], 0, []
                    if head is not None:
                        name, at = first_word(head[1:]), 0
                    else:
                        name, at = shared.value.get(now, (None, 0))[:2]
                    split = now
                held.append(cleaned(text, convert, validate, name or "?"))
                size += len(held[-1])
                if size >= CHUNK and name is not None:
                    yield from cut()
                    at, held, size = at + size, [], 0
            if name is not None:
                yield from cut()
                yield from ends(shared.value[split][2])

        found = self._lines().mapInArrow(_batched(run, PIECES), PIECES)
        return joined_pieces(found, segments.select("seg_id", "linear").join(self.lengths().hint("merge"), "seg_id"), tile)


# --- random access ----------------------------------------------------------------------------------------------------------

def _opened(path: str):
    """A file for reading ranges: local, or of any store that the file system library of Arrow opens."""
    if path.startswith("file:"):
        return pf.LocalFileSystem().open_input_file(unquote("/" + path.removeprefix("file:").lstrip("/")))
    fs, where = pf.FileSystem.from_uri(path)
    return fs.open_input_file(where)


class _Reader:
    """Opens files one after the other; the one that was read last stays open, as records lie beside each other."""

    def __init__(self):
        self.path = self.file = None

    def at(self, path: str):
        if path != self.path:
            self.__exit__()
            self.path, self.file = path, _opened(path)
        return self.file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.file is not None:
            self.file.close()


#: Rows of a batch that a task hands on: a record or a piece of a tile each, so that short records don't go one by one.
BATCH = 512
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _batched(rows, schema: str):
    """A function of Arrow batches from one that yields rows of the schema."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = iter(rows(batches))
        while held := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(x, _ARROW[t]) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], list(names))

    return run


_INDEX_ROWS = "seg_id string, file string, first long, until long, bases long, width long, regular boolean"


def _line_shape(f, first: int, until: int) -> tuple[int, int, bool]:
    """Bases and bytes of each line of a record but the last, and whether that holds for all; one line counts byte by byte."""
    f.seek(first)
    at, last, width, late, alike = first, first - 1, 0, None, True
    lines = returns = blanks = 0
    while at < until:
        data = f.read(min(CHUNK, until - at))
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + at
        if len(ends):
            each = np.diff(np.r_[last, ends]) if late is None else np.r_[late, np.diff(np.r_[last, ends])]
            width, late, last = width or int(each[0]), int(each[-1]), int(ends[-1])
            alike &= bool((each[:-1] == width).all())
        lines, returns, blanks = lines + len(ends), returns + data.count(b"\r"), blanks + data.count(b" ") + data.count(b"\t")
        at += len(data)
    rest = until - 1 - last
    if not lines or (lines == 1 and not rest):
        return 1, 1, not returns and not blanks
    alike &= late <= width if not rest else late == width and rest <= width
    return width - 1 - (returns > 0), width, bool(alike and not blanks and returns in (0, lines))


class IndexedFiles(SequenceFiles):
    """The same for plain files in a store that allows ranges: tiles of some segments cost their own bytes only.

    The index is kept in the store under the files' stamp. Records whose lines aren't of one width (but the last) are read by
    one task each, in blocks.
    """

    def index(self) -> DataFrame:
        return Store(self.spark).whole("fasta-index", self.stamp, self._indexed)

    def _ranges(self) -> DataFrame:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(where, True)
        rows = []
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                rows.append((f.getPath().toString(), f.getLen()))
        cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(RANGE).cast("long"))
        return self.spark.createDataFrame(rows, "file string, size long").withColumn("begin", F.explode(cut)).repartition(sc.defaultParallelism, "file", "begin")

    def _indexed(self) -> DataFrame:
        """Headers of each range, then bytes from each header's end to the next header, then the shape of the lines."""
        def headers(batches):
            for b in batches:
                for file, size, begin in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    with _opened(file) as f:
                        f.seek(max(begin - 1, 0))
                        data = (b"\n" if not begin else b"") + f.read(min(RANGE, size - begin) + (begin > 0))
                        at = data.find(b"\n>")
                        while at >= 0:
                            start = begin + at  # of the header's mark
                            end = data.find(b"\n", at + 1)
                            if end >= 0:
                                line = data[at + 2 : end]
                            else:
                                f.seek(start)
                                line = b""
                                while not line.endswith(b"\n") and (more := f.read(1 << 16)):
                                    line += more if b"\n" not in more else more[: more.index(b"\n") + 1]
                                end = at + len(line) if line.endswith(b"\n") else at + len(line) + 1
                                line = line[1:].rstrip(b"\n")
                            yield first_word(line), file, start, min(begin + end, size), size
                            at = data.find(b"\n>", at + 1)

        marks = "seg_id string, file string, mark long, first long, size long"
        found = written(self._ranges().select("file", "size", "begin").mapInArrow(_batched(headers, marks), marks))
        if not found.limit(1).count():
            raise SequenceError("no sequences")
        ordered = prefix.numbered(found, ["file", "mark"])
        after = ordered.select((F.col("n") - 1).alias("n"), F.col("file").alias("f2"), F.col("mark").alias("m2"))
        ends = ordered.join(after, "n", "left").select("seg_id", "file", "first", F.when(F.col("f2") == F.col("file"), F.col("m2")).otherwise(F.col("size")).alias("until"))

        def shapes(batches):
            with _Reader() as files:
                for b in batches:
                    for seg, file, first, until in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        yield seg, file, first, until, *_line_shape(files.at(file), first, until)

        return ends.repartition(self.spark.sparkContext.defaultParallelism, "seg_id").mapInArrow(_batched(shapes, _INDEX_ROWS), _INDEX_ROWS)

    def taken(self, segments: DataFrame, overlap: int, tile: int = TILE) -> DataFrame:
        """Pieces of the segments, with the bytes that were read for each in ``read``."""
        spans = RANGE // 4
        wanted = self.index().join(segments.select("seg_id"), "seg_id").join(self.lengths().hint("merge"), "seg_id")
        step = F.when(F.col("regular"), F.greatest(F.lit(spans) - F.lit(spans) % F.col("width"), F.col("width"))).otherwise(F.greatest(F.col("until") - F.col("first"), F.lit(1)))
        each = wanted.where("until > first").withColumn("step", step).withColumn("from", F.explode(F.sequence("first", F.col("until") - 1, F.col("step"))))
        convert, validate = self.convert, self.validate

        def run(batches):
            with _Reader() as files:
                for b in batches:
                    for seg, file, first, until, bases, width, step, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        # Ranges begin at the start of a line of known width.
                        at, left = (start - first) // width * bases if start > first else 0, min(step, until - start)
                        f = files.at(file)
                        f.seek(start)
                        while left > 0:
                            size = min(CHUNK, left)
                            text = cleaned(f.read(size), convert, validate, seg)
                            left -= size
                            for k, piece in enumerate(chain(pieces(seg, at, text, overlap, tile), turned(seg, n, at, text, overlap, tile))):
                                yield *piece, 0 if k else size
                            at += len(text)

        columns, out = ["seg_id", "file", "first", "until", "bases", "width", "step", "from", "length"], f"{PIECES}, read long"
        return each.select(columns).repartition(self.spark.sparkContext.defaultParallelism, "seg_id", "from").mapInArrow(_batched(run, out), out)

    def lengths(self) -> DataFrame:
        """(seg_id, length) by the index where lines are regular; other records are counted."""
        if self._lengths is not None:
            return self._lengths
        index = self.index()
        again = index.groupBy("seg_id").count().where("count > 1").limit(5).collect()
        if again:
            raise SequenceError("repeated names: " + ", ".join(r[0] for r in again))
        self._lengths = written(index.select("seg_id", "first", "until", "bases", "width", "regular", "file").mapInArrow(_measured, "seg_id string, length int"))
        return self._lengths

    def tiles(self, segments: DataFrame, overlap: int, tile: int = TILE) -> DataFrame:
        found = self.taken(segments, overlap, tile).drop("read")
        return joined_pieces(found, segments.select("seg_id", "linear").join(self.lengths().hint("merge"), "seg_id"), tile)


def _measured(batches):
    for b in batches:
        out = []
        for seg, first, until, bases, width, regular, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
            size, n = until - first, 0
            with _opened(file) as f:
                if regular and size:
                    full, rest = divmod(size, width)
                    # The last line, and the end of the line before it.
                    back = rest if rest or not full else width
                    f.seek(until - back)
                    n = (size - back) // width * bases + len(f.read(back).translate(None, _BLANK))
                else:
                    f.seek(first)
                    while size > 0:
                        n += len(f.read(min(CHUNK, size)).translate(None, _BLANK))
                        size -= CHUNK
            out.append((seg, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32())], ["seg_id", "length"])


def opened(spark: SparkSession, path: str, convert: bool = False, validate: bool = True, some: bool = False) -> SequenceFiles:
    """The files as a source: by ranges if just some of their segments are asked for and ranges can be read, else by
    scans."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    plain = not path.endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate"))
    return (IndexedFiles if some and plain and scheme == "file" else SequenceFiles)(spark, path, convert, validate)
