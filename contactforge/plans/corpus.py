"""The registered queries read `documents` as a stand-in for genomes: letter i of the alphabet becomes base i mod 4.

segment = doc_id, replicon = (source, lang), cell = source; copies and abundances follow from the names. Each
query stands beside its SQL for a second engine; both use the same draws.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import distributions
from ..functions import sequence as sq
from ..operators.enzymes import enzyme

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
SEED = 1


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_BASE = bytes.maketrans((LETTERS + LETTERS.lower()).encode(), (BASES * 2).encode())
_REST = bytes(set(range(256)) - set((LETTERS + LETTERS.lower()).encode()))


@F.arrow_udf(StringType())
def dna(text: pa.Array) -> pa.Array:
    """Bytes that aren't letters go, letters become bases, in one step a text: a regular expression and ``translate`` take
    each character on its own. No byte of a longer symbol is a letter."""
    return pa.array([None if x is None else x.translate(_BASE, _REST) for x in text.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Much work on few input splits is dealt out first; tables of many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def genome(spark: SparkSession, d: str) -> DataFrame:
    docs = dealt(table(spark, d, "documents").where(F.col("text").rlike("[A-Za-z]")).select("doc_id", "source", "lang", "text"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("seg_id"), F.col("source").alias("cell"), F.col("lang").alias("repl"), dna(F.col("text")).alias("seq"))


def segments(spark: SparkSession, d: str, linear=None) -> DataFrame:
    """Rows without letters fall out when they meet the sequences."""
    docs = table(spark, d, "documents")
    n = F.substring("source", 4, 9).cast("int")
    copies = F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 2.0).when(F.col("lang") == "fr", 3.0).otherwise(4.0)
    shape = F.lit(False) if linear is None else linear
    return docs.select(F.col("doc_id").cast("string").alias("seg_id"), F.col("source").alias("cell"), F.col("lang").alias("repl"), (1.0 + n % 5).alias("abundance"), copies.alias("copy_number"), shape.alias("linear"))


#: Linear molecules of the mixed queries.
LINEAR_SQL = "repl = 'de'"

GENOME = f"""genome AS (
  SELECT * FROM (SELECT doc_id::VARCHAR AS seg_id, source AS cell, lang AS repl,
    translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq,
    1.0::DOUBLE + substr(source, 4, 9)::INT % 5 AS abundance,
    CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END::DOUBLE AS copy_number FROM documents) WHERE length(seq) > 0
)"""


def sites_sql(names: list[str], linear: str = "FALSE") -> str:
    """CTEs segs (with length and linear) and sites (seg_id, pos, enz, rank) for the enzymes."""
    parts, longest = [], max(len(enzyme(n).site) for n in names) - 1
    for i, n in enumerate(names):
        e = enzyme(n)
        pattern = sq.site_pattern(e.site)
        parts.append(f"""SELECT seg_id, length, linear, {e.cut} AS cut, {i} AS enz, {len(e.site)} AS size,
      regexp_split_to_array(seq || CASE WHEN linear THEN '' ELSE substr(seq, 1, least({longest}, length)) END, '{pattern}') AS pieces FROM segs""")
    return f"""segs AS (SELECT *, length(seq) AS length, ({linear}) AS linear FROM genome),
pieces AS ({' UNION ALL '.join(parts)}),
found AS (
  SELECT seg_id, length, linear, cut, enz, ord, sum(length(piece)) OVER (PARTITION BY seg_id, enz ORDER BY ord) + (ord - 1) * size AS place, ord = n AS final
  FROM (SELECT seg_id, length, linear, cut, enz, size, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS ord, len(pieces) AS n FROM pieces)
),
cuts AS (SELECT DISTINCT seg_id, ((place + cut) % length)::INT AS pos, enz FROM found WHERE NOT final AND place < length AND (NOT linear OR place + cut < length)),
sites AS (SELECT *, (row_number() OVER (PARTITION BY seg_id ORDER BY pos, enz) - 1)::INT AS rank FROM cuts)"""


def u_sql(name: str, *keys: str, part: int = 0, seed: int = SEED) -> str:
    joined = "||':'||".join([f"'{seed}:{name}'", *(f"({k})::VARCHAR" for k in keys)])
    return f"(('0x'||substr(md5({joined}), {8 * part + 1}, 8))::BIGINT / 4294967296::DOUBLE)"


USABLE = """counts AS (SELECT seg_id, count(*) AS n_sites FROM sites GROUP BY seg_id),
usable AS (SELECT s.*, c.n_sites, round(copy_number * 1000)::BIGINT AS copy_milli,
  (SELECT count(DISTINCT t.repl) FROM segs t JOIN counts k USING (seg_id) WHERE t.cell = s.cell) AS n_repl FROM segs s JOIN counts c USING (seg_id))"""


def running_sql(weight: str, name: str, source: str = "usable") -> str:
    return f"""{name} AS (SELECT *, hi - w AS lo, min(hi - w) OVER (PARTITION BY cell, repl) AS repl_lo, max(hi) OVER (PARTITION BY cell, repl) AS repl_hi,
  min(hi - w) OVER (PARTITION BY cell) AS cell_lo, max(hi) OVER (PARTITION BY cell) AS cell_hi, max(hi) OVER () AS total
  FROM (SELECT seg_id, cell, repl, length, linear, n_sites, n_repl, ({weight})::BIGINT AS w, (sum(({weight})::BIGINT) OVER (ORDER BY cell, repl, seg_id))::BIGINT AS hi FROM {source}))"""


NEAREST = """gap0 AS (SELECT seg_id, pos, min(enz) AS enz FROM sites GROUP BY seg_id, pos),
gap1 AS (SELECT seg_id, pos AS p, enz AS e, lead(pos) OVER w AS np, lead(enz) OVER w AS ne FROM gap0 WINDOW w AS (PARTITION BY seg_id ORDER BY pos)),
edge AS (SELECT g.seg_id, min(pos) AS fp, max(pos) AS lp, arg_min(enz, pos) AS fe, arg_max(enz, pos) AS le, any_value(length) AS length, any_value(linear) AS linear FROM gap0 g JOIN segs USING (seg_id) GROUP BY g.seg_id)"""


def near_sql(rows: str, seg: str, pos: str) -> str:
    """Rows with lo, lo_enz, hi, hi_enz and the edge's columns."""
    return f"""(SELECT r.*, fp, lp, fe, le, e.length AS elen, e.linear AS elin,
    coalesce(g.p, CASE WHEN NOT e.linear THEN lp - (e.length - 1) END) AS lo, coalesce(g.e, CASE WHEN NOT e.linear THEN le END) AS lo_enz, g.p AS real_lo, g.e AS real_lo_enz,
    CASE WHEN g.p IS NULL THEN fp ELSE coalesce(g.np, CASE WHEN NOT e.linear THEN fp + (e.length - 1) END) END AS hi,
    CASE WHEN g.p IS NULL THEN fe ELSE coalesce(g.ne, CASE WHEN NOT e.linear THEN fe END) END AS hi_enz,
    CASE WHEN g.p IS NULL THEN fp ELSE g.np END AS real_hi, CASE WHEN g.p IS NULL THEN fe ELSE g.ne END AS real_hi_enz
  FROM {rows} r JOIN edge e ON e.seg_id = r.{seg} ASOF LEFT JOIN gap1 g ON g.seg_id = r.{seg} AND r.{pos} >= g.p)"""


def nearest_sql(pos: str) -> tuple[str, str]:
    low = f"(hi IS NULL OR (lo IS NOT NULL AND {pos} - lo <= hi - {pos}))"
    at = f"CASE WHEN {low} THEN lo ELSE hi END"
    turn = "(elen - 1)"
    return f"(CASE WHEN elin OR elen < 2 THEN {at} ELSE (({at}) % {turn} + {turn}) % {turn} END)", f"(CASE WHEN {low} THEN lo_enz ELSE hi_enz END)"


def inverse_sql(u: str, length: str, bins: int = distributions.BINS, alpha: float = distributions.ALPHA, shape: float = distributions.SHAPE) -> str:
    """The bisected inverse, with the bin found among all bins."""
    x = lambda k: f"({length} * {k} / {bins - 1}.0::DOUBLE)"
    f = lambda k: f"(({1.0 - alpha!r}::DOUBLE * (1.0 - pow({1.0 - shape!r}::DOUBLE, {x(k)})) + {alpha!r}::DOUBLE * {x(k)} / {length}))"
    top = f"({1.0 - alpha!r}::DOUBLE * (1.0 - pow({1.0 - shape!r}::DOUBLE, {length}::DOUBLE)) + {alpha!r}::DOUBLE * {length}::DOUBLE / {length})"
    k = f"(len(list_filter(range({bins}), lambda k: {f('k')} / {top} <= {u})) - 1)"
    return k, x, lambda kk: f"{f(kk)} / {top}"
