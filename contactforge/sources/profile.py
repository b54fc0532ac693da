"""Community profiles: tables, TOML, and procedural ones."""
from __future__ import annotations

import json
import logging
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContactError
from ..functions.draws import normal, unit
from ..operators.prefix import numbered, running

log = logging.getLogger(__name__)
SCHEMA = "seg_id string, cell string, repl string, abundance double, copy_number double"


def read_table(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """Tab-separated segment, cell, replicon, abundance, copy number; blank lines and # lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("ord"))
    lines = lines.where("value != '' AND NOT startswith(value, '#')")
    parts = F.split("value", "\t")
    ok = F.when(F.size(parts) == 5, parts).otherwise(F.raise_error(F.concat(F.lit("five fields are needed: "), "value")))
    cast = [F.element_at(ok, i + 1).cast(t).alias(n) for i, (n, t) in enumerate(f.split(" ") for f in SCHEMA.split(", "))]
    return settle(lines.select(*cast, "ord"), normalise)


def settle(rows: DataFrame, normalise: bool = False, order: str = "ord") -> DataFrame:
    """The first row of a cell gives its abundance, the first of a replicon its copy number."""
    cells = rows.groupBy("cell").agg(F.min_by("abundance", order).alias("abundance"))
    repls = rows.groupBy("cell", "repl").agg(F.min_by("copy_number", order).alias("copy_number"))
    if normalise:
        cells = cells.withColumn("abundance", F.col("abundance") / cells.select(F.sum("abundance")).scalar())
    return rows.select("seg_id", "cell", "repl").join(repls, ["cell", "repl"]).join(cells, "cell").select("seg_id", "cell", "repl", "abundance", "copy_number")


def normalise_last(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(cell, abundance, conflicting): the last row of a cell counts; says whether its rows differ."""
    cells = rows.groupBy("cell").agg(F.max_by("abundance", order).alias("abundance"), (F.countDistinct("abundance") > 1).alias("conflicting"))
    return cells.withColumn("abundance", F.col("abundance") / cells.select(F.sum("abundance")).scalar())


def read_toml(spark: SparkSession, text: str, normalise: bool = False, trans_rate: float = 0.1, anti_rate: float = 0.2, linear: bool = False) -> tuple[DataFrame, float | None]:
    """(segments, spurious rate or None) from nested cells, replicons and segments; missing rates take defaults."""
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ContactError(f"bad profile: {e}") from e
    if "profile_version" not in found:
        log.warning("the profile names no version")
    if "community" not in found or "cells" not in found["community"]:
        raise ContactError("the profile has no community with cells")
    rows = []
    for cell in found["community"]["cells"]:
        for repl in cell["replicons"]:
            for seg in repl["segments"]:
                rows.append((len(rows), seg, cell["name"], repl["name"], float(cell["abundance"]), float(repl["copy_number"]), float(cell.get("trans_rate", trans_rate)), float(repl.get("anti_rate", anti_rate)), bool(repl.get("linear", linear))))
    df = spark.createDataFrame(rows, "ord int, seg_id string, cell string, repl string, abundance double, copy_number double, trans_rate double, anti_rate double, linear boolean")
    return _with_rates(df, normalise), found["community"].get("spurious_rate")


def _with_rates(df: DataFrame, normalise: bool) -> DataFrame:
    first = settle(df, normalise).select("seg_id", "cell", "repl", "abundance", "copy_number")
    return first.join(df.select("seg_id", "cell", "repl", "trans_rate", "anti_rate", "linear").hint("merge"), ["seg_id", "cell", "repl"])


_HEADS = {"[community]": "community", "[[community.cells]]": "cell", "[[community.cells.replicons]]": "repl"}
_TOML_ROWS = "block long, line long, head string, is_cell long, is_repl long, key string, value string, seg string"


def _toml_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each line says: a heading, a key with its value as JSON, or names of segments (one row each)."""
    def names(text: str) -> list | None:
        inside = text.removesuffix("]") if text.endswith("]") else text
        try:
            found = tomllib.loads(f"v = [\n{inside}\n]")["v"]
        except tomllib.TOMLDecodeError:
            return None
        return found if all(isinstance(x, str) for x in found) else None

    def entries(text: str) -> list[tuple]:
        bare = text.strip()
        head = bare.split("#", 1)[0].replace(" ", "").replace("\t", "")
        if not head:
            return []
        if head[0] == "[":
            return [(_HEADS.get(head, "other"), None, None, None)]
        if head == "segments=[" or head.strip("],") == "":
            return []
        if bare[0] in "\"'" and (listed := names(bare)) is not None:
            return [(None, None, None, x) for x in listed]
        if head.startswith("segments=[") and not head.endswith("]"):
            bare += "]"
        try:
            found = tomllib.loads(bare)
        except tomllib.TOMLDecodeError as e:
            raise ContactError(f"bad profile: {e} in a line that should hold one entry: {bare[:80]}") from e
        return [(None, None, None, x) for x in found["segments"]] if "segments" in found else [(None, k, json.dumps(v, default=str), None) for k, v in found.items()]

    for b in batches:
        rows = [(block, line, *e) for block, line, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for e in entries(text)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        head = columns[2]
        made = [*columns[:3], [int(h == "cell") for h in head], [int(h == "repl") for h in head], *columns[3:]]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, types, strict=True)], [x.split(" ")[0] for x in _TOML_ROWS.split(", ")])


def read_toml_lines(spark: SparkSession, path: str, normalise: bool = False, trans_rate: float = 0.1, anti_rate: float = 0.2, linear: bool = False) -> tuple[DataFrame, float | None]:
    """``read_toml`` of one file of any size whose lines hold one heading, one key, or some segments of a list each, as
    ``write_toml`` writes them; other layouts are an error. Lines are read by Spark's splits; running counts of the headings
    say which cell and replicon a line belongs to, so that neither the driver nor a task holds the profile."""
    text = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    found = text.mapInArrow(_toml_entries, _TOML_ROWS).withColumn("is_head", F.col("head").isNotNull().cast("long"))
    rows = running(found, ["block", "line"], {"h": "is_head", "c": "is_cell", "r": "is_repl"})
    heads = rows.where("head IS NOT NULL").select("h", F.col("head").alias("section"))
    keys = rows.where("key IS NOT NULL").select("h", "c", "r", "key", "value").join(heads.hint("merge"), "h", "left")
    if not rows.where("key = 'profile_version'").limit(1).count():
        log.warning("the profile names no version")
    if not rows.where("head = 'cell'").limit(1).count():
        raise ContactError("the profile has no community with cells")

    def one(key: str, kind: str, default=None) -> Column:
        own = F.max(F.when(F.col("key") == key, F.col("value")))
        value = F.get_json_object(F.concat(F.lit('{"v":'), own, F.lit("}")), "$.v").cast(kind)
        missing = F.raise_error(F.lit(f"bad profile: {key} is missing")).cast(kind) if default is None else F.lit(default).cast(kind)
        return F.coalesce(value, missing)

    cells = keys.where("section = 'cell'").groupBy("c").agg(one("name", "string").alias("cell"), one("abundance", "double").alias("abundance"), one("trans_rate", "double", trans_rate).alias("trans_rate"))
    repls = keys.where("section = 'repl'").groupBy("c", "r").agg(one("name", "string").alias("repl"), one("copy_number", "double").alias("copy_number"), one("anti_rate", "double", anti_rate).alias("anti_rate"), one("linear", "boolean", linear).alias("linear"))
    df = rows.where("seg IS NOT NULL").select("r", F.col("seg").alias("seg_id")).join(repls, "r").join(cells, "c")
    rate = keys.where("section = 'community' AND key = 'spurious_rate'").select("value").first()
    return _with_rates(df.withColumnRenamed("r", "ord"), normalise), None if rate is None else float(json.loads(rate[0]))


def hierarchy(segments: DataFrame) -> DataFrame:
    """One row a cell: cell, abundance, replicons (array of repl, copy_number, segments), all in order of name."""
    repls = segments.groupBy("cell", "repl").agg(F.first("copy_number").alias("copy_number"), F.first("abundance").alias("abundance"), F.array_sort(F.collect_list("seg_id")).alias("segments"))
    return repls.groupBy("cell").agg(F.first("abundance").alias("abundance"), F.array_sort(F.collect_list(F.struct("repl", "copy_number", "segments"))).alias("replicons"))


def table_rows(profile: DataFrame) -> DataFrame:
    """Profile rows in writing order, with the text line of each."""
    order = F.concat("cell", "repl", "seg_id")
    line = F.format_string("%s\t%s\t%s\t%f\t%d", "seg_id", "cell", "repl", "abundance", F.col("copy_number").cast("int"))
    return profile.withColumn("line", line).withColumn("ord", order)


def distribute(taxa: DataFrame, mode: str, seed: int = 1, mu: float = 1.0, sigma: float = 1.0, key: str = "name") -> DataFrame:
    """Adds abundance to taxa: equal, uniform or lognormal, summing to 1. Draws go by rank in order of name."""
    ranked = numbered(taxa, [key], "rank").withColumn("rank", F.col("rank").cast("int"))
    weight: Column
    if mode == "equal":
        weight = F.lit(1.0)
    elif mode == "uniform":
        weight = unit(seed, "abundance", "rank")
    elif mode == "lognormal":
        weight = F.exp(F.lit(mu) + F.lit(sigma) * normal(seed, "abundance", "rank"))
    else:
        raise ContactError(f"unknown distribution {mode}")
    return ranked.withColumn("abundance", weight / ranked.select(F.sum(weight)).scalar())


def long_name(cell: Column, repl: Column, name: Column) -> Column:
    return F.concat_ws("-", cell, repl, name)


def effective_abundance(abundance: Column, copies: Column) -> Column:
    return abundance * copies
