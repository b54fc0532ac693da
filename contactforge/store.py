"""Tables of digested sequences that are kept between runs, addressed by what they are made from.

A segment is known by its name and a digest of its sequence and shape. For each *kind* of table (tiles of one overlap, sites
or gaps of one set of enzymes) the store holds generations: rows of the segments that were new when it was written, beside an
index of them. A run asks for the segments it has; what no generation holds is made and becomes a generation of its own, so
that a changed base costs its own segment's work only, and what isn't asked for isn't read.

Telling segments by digest still reads all sequences once. Where the caller can say what they come from (a *stamp*: files
with their sizes and times, and what is done to them), a run with a known stamp reads no sequence at all, and whole tables
(weights of a community) are kept under it too.

The store lies where ``spark.contactforge.store.dir`` says, and stays there; without it, in the shared folder until the
process ends. A generation counts once its index has been renamed into place; a writer that is lost leaves files that
nobody reads, and two writers of one segment are told apart by the order of their names.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import renamed, shared_folder, unowned

SETTING = "spark.contactforge.store.dir"
INDEX = "seg_id string, digest string, length int, linear boolean"


def _short(*what) -> str:
    return hashlib.sha256(json.dumps(what, default=str).encode()).hexdigest()[:32]


def _where(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def file_stamp(spark: SparkSession, path: str, *how) -> str:
    """What a file, or a folder of files, holds as far as names, sizes and times tell, and ``how`` it is read."""
    fs, where = _where(spark, path)
    files, found = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return _short(sorted(found), *how)


def identified(sequences: DataFrame) -> DataFrame:
    """(seg_id, digest, length, linear) of (seg_id, linear, seq)."""
    digest = F.sha2(F.concat(F.when(F.col("linear"), "l").otherwise("c"), "seq"), 256)
    return sequences.select("seg_id", digest.alias("digest"), F.length("seq").alias("length"), "linear")


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        named = spark.conf.get(SETTING, None)
        self.root = named.rstrip("/") if named else unowned(spark, f"{shared_folder(spark)}/store-{spark.sparkContext.applicationId}")

    # --- files ---

    def _listed(self, folder: str) -> list[str]:
        fs, where = _where(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _committed(self, df: DataFrame, folder: str) -> None:
        """Written beside its place and renamed into it: there as a whole or not at all."""
        beside = f"{self.root}/pending-{uuid.uuid4().hex}"
        df.write.parquet(beside)
        renamed(self.spark, beside, f"{self.root}/{folder}")  # unless another writer was first

    def _noted(self, name: str, value: list | None = None) -> list | None:
        """A small note, written if a value is given, else read."""
        fs, where = _where(self.spark, f"{self.root}/notes/{name}")
        if value is not None:
            out = fs.create(where, True)
            out.write(bytearray(json.dumps(value).encode()))
            out.close()
            return value
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        text = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
        stream.close()
        try:
            return json.loads(bytes(text))
        except ValueError:  # a writer was lost in between
            return None

    def clear(self) -> None:
        """Delete all that is kept."""
        fs, where = _where(self.spark, self.root)
        fs.delete(where, True)

    # --- tables of segments ---

    def generations(self, kind: str) -> list[str]:
        return [n.removeprefix("index-") for n in self._listed(kind) if n.startswith("index-")]

    def _index(self, kind: str, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.schema(INDEX).parquet(f"{self.root}/{kind}/index-{g}").withColumn("generation", F.lit(g)) for g in names))

    def _data(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}/data-{name}")

    def known(self, kind: str, stamp: str | None) -> list[str] | None:
        """Generations that together hold just the segments of the stamp, if a run has noted them."""
        names = None if stamp is None else self._noted(_short(kind, stamp))
        return names if names and set(names) <= set(self.generations(kind)) else None

    def index(self, stamp: str | None) -> DataFrame | None:
        """The segments of a stamp, if a run has noted them for any kind of table."""
        for kind in [] if stamp is None else [k for k in self._listed("") if k not in ("notes", "whole") and not k.startswith("pending-")]:
            if names := self.known(kind, stamp):
                return self._index(kind, names).drop("generation")
        return None

    def rows(self, kind: str, wanted: Callable[[], DataFrame], make: Callable[[DataFrame], DataFrame], stamp: str | None = None) -> DataFrame:
        """The kind's rows of the wanted segments (an index, asked for only if the stamp isn't known). ``make`` gives the
        rows, with seg_id, of those (seg_id, digest, length, linear) that are new."""
        names = self.known(kind, stamp)
        if names:
            return reduce(DataFrame.unionByName, (self._data(kind, g) for g in names))
        asked = wanted()
        names = self.generations(kind)
        new = asked.join(self._index(kind, names).hint("merge"), ["seg_id", "digest"], "left_anti") if names else asked
        if not names or new.limit(1).count():
            name = uuid.uuid4().hex
            make(new).write.parquet(f"{self.root}/{kind}/data-{name}")
            self._committed(new, f"{kind}/index-{name}")
            names = self.generations(kind)
        held = self._index(kind, names)
        mine = held.join(asked.select("seg_id", "digest").hint("merge"), ["seg_id", "digest"]).groupBy("seg_id").agg(F.min("generation").alias("generation"))
        there, used = ({r[0]: r[1] for r in t.groupBy("generation").count().collect()} for t in (held, mine))
        whole = [g for g in names if g in used and used[g] == there[g]]
        if stamp is not None and used and len(whole) == len(used):
            self._noted(_short(kind, stamp), whole)
        parts = [self._data(kind, g) if g in whole else self._data(kind, g).join(mine.where(F.col("generation") == g).select("seg_id").hint("merge"), "seg_id", "left_semi") for g in names if g in used]
        return reduce(DataFrame.unionByName, parts) if parts else self._data(kind, names[0]).limit(0)

    # --- whole tables ---

    def whole(self, kind: str, stamp: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is known by its stamp alone."""
        folder = f"whole/{kind}-{_short(kind, stamp)}"
        fs, where = _where(self.spark, f"{self.root}/{folder}")
        if not fs.exists(where):
            self._committed(make(), folder)
        return self.spark.read.parquet(f"{self.root}/{folder}")
