"""Proximity-ligation experiments as one logical plan: hic, meta3c and dnase.

Every pair draws all of its decisions from its number. A pair's first end is one lookup in the running weights, its
second end another, whatever the kind of pair: the kind only decides in which stretch of the one running weight the
number is drawn (the community's, the replicon's, the cell's without the replicon). Positions, nearest sites, and the
two parts of the template are equi-joins on segment and rank, or segment and tile.
"""
from __future__ import annotations

import logging
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContactError, EmptyCommunity, NoCutSites
from ..functions.distributions import ALPHA, ALPHA_DOCUMENTED, SHAPE, inverse
from ..functions.draws import NORMAL_BOUND, below, normal, unit
from ..functions.sequence import reverse_complement
from ..operators import digest, reads, slices, weights
from ..operators.enzymes import enzyme, junctions
from ..sources.fasta import check_unique
from ..sources.tiled import SequenceFiles
from ..storage import removed, written
from ..store import Store, identified

log = logging.getLogger(__name__)
METHODS = {"hic": 0.5, "meta3c": 0.02, "dnase": 0.5}


@dataclass
class Settings:
    """What an experiment is asked for. ``documented`` follows the model's description where practice differs: reverse
    inserts are reversed, linear parts reach the last base, cells weigh by their abundance, indel tails start at
    one, and the separation mixes in a tenth of uniform draws."""

    method: str = "hic"
    enzymes: list[str] = field(default_factory=list)
    seed: int = 1
    read_length: int = 150
    prefix: str = "SIM"
    insert_mean: int = 400
    insert_sd: int = 50
    insert_min: int = 100
    insert_max: int | None = None
    efficiency: float | None = None
    anti_rate: float = 0.2
    trans_rate: float = 0.1
    spurious_rate: float = 0.02
    bridge: str | None = None
    simple: bool = True
    ins_rate: float = 9e-5
    del_rate: float = 1.1e-4
    documented: bool = False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ContactError(f"unknown method {self.method}")
        if self.method == "dnase" and self.enzymes:
            raise ContactError("dnase takes no enzymes")
        if self.method != "dnase" and not 1 <= len(self.enzymes) <= 2:
            raise ContactError("one or two enzymes are needed")
        if self.bridge is not None and self.method != "dnase":
            raise ContactError("a bridge is for dnase only")
        if self.bridge is not None:
            self.bridge = self.bridge.upper()
            if not self.bridge or set(self.bridge) - set("ACGT"):
                raise ContactError("a bridge holds ACGT only")
        if not 50 < self.insert_min < self.insert_mean or self.insert_sd <= 0:
            raise ContactError("inserts need 50 < minimum < mean and a positive deviation")
        if self.insert_max is not None and self.insert_max <= self.insert_mean:
            raise ContactError("the largest insert must be above the mean")
        if self.read_length < 1:
            raise ContactError("reads need a positive length")
        if self.insert_mean < self.insert_sd:
            log.warning("insert mean %s is below its deviation %s", self.insert_mean, self.insert_sd)
        if self.insert_mean - self.insert_sd < self.insert_min:
            log.warning("many inserts will be raised to the minimum %s", self.insert_min)
        if self.method == "dnase" and self.bridge is None:
            log.warning("dnase without a bridge: parts are joined plainly")
        self.efficiency = self.efficiency or METHODS[self.method]

    @property
    def longest_insert(self) -> int:
        """No draw gives more."""
        free = ceil(self.insert_mean + NORMAL_BOUND * self.insert_sd)
        return max(self.insert_min, free if self.insert_max is None else min(free, self.insert_max))


class Community:
    """segments (seg_id, cell, repl, length, linear, copy_milli, anti_rate, trans_rate, n_repl, n_sites, weights), the
    tiles of their sequences, cut sites, gaps and running weights: each is made when first asked for, and kept in the
    store (see ``store``), as every pair looks things up in them several times and other runs may need them too."""

    def __init__(self, segments: DataFrame, sequences: DataFrame | SequenceFiles, settings: Settings, stamp: str | None = None):
        self.spark, self.store, self.stamp = segments.sparkSession, Store(segments.sparkSession), stamp
        self.enzymes = [enzyme(n) for n in settings.enzymes]
        self.overlap = max([settings.longest_insert, *(len(e.site) - 1 for e in self.enzymes)])
        self._shapes, self._files = segments.select("seg_id", "linear"), sequences if isinstance(sequences, SequenceFiles) else None
        self._sequences = None if self._files else sequences if "linear" in sequences.columns else self._shapes.join(sequences, "seg_id")
        self._key = "-".join(f"{e.site}.{e.cut}" for e in self.enzymes)
        self._kept: dict[str, DataFrame] = {}
        self._few: bool | None = None
        # What follows from the profile and the rates is kept under all of them; without a stamp, for this community.
        rates = (settings.documented, settings.anti_rate, settings.trans_rate, self._key)
        self._stamp = None if stamp is None else f"{stamp} {rates}"
        self.segments = self._whole("segments", lambda: self._weighed(segments, settings))

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def _whole(self, kind: str, make) -> DataFrame:
        return self._once(kind, lambda: written(make()) if self._stamp is None else self.store.whole(kind, self._stamp, make))

    def _index(self) -> DataFrame:
        """Digests of all sequences: they are read for it, but only where the stamp isn't known. Segments of files go by the
        files' stamp instead."""
        known = self.store.index(self.stamp)
        if known is not None:
            return self._once("index", lambda: known)
        if self._files:
            where = F.lit(self._files.stamp)
            return self._once("index", lambda: written(self._shapes.join(self._files.lengths(), "seg_id").select("seg_id", F.concat(where, F.when(F.col("linear"), "l").otherwise("c")).alias("digest"), "length", "linear")))
        return self._once("index", lambda: written(identified(self._sequences)))

    def _digested(self, kind: str, make) -> DataFrame:
        return self._once(kind, lambda: self.store.rows(kind, self._index, make, self.stamp))

    def _cut(self, new: DataFrame, overlap: int) -> DataFrame:
        """Tiles of new segments. One long sequence is one input row: its tiles are dealt out before the work on them."""
        if self._files:
            return self._files.tiles(new.select("seg_id", "linear"), overlap)
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return digest.tiles(self._of(self._sequences, new), overlap).repartition(spread, "seg_id", "tile")

    def _of(self, rows: DataFrame, new: DataFrame) -> DataFrame:
        """The new segments' rows: all of them, without a join, if no segment is known."""
        return rows if new is self._kept.get("index") else rows.join(new.select("seg_id").hint("merge"), "seg_id", "left_semi")

    @property
    def few(self) -> bool:
        """Whether sites, gaps and tiles are few enough to be sent to every task: by their counts, as a file's size says little
        about its rows in memory."""
        if self._few is None:
            n, sites, bases = self.segments.agg(F.count("*"), F.sum("n_sites"), F.sum(F.col("length").cast("long"))).first()
            self._few = 5 * n <= weights.FEW and (not n or (sites if self.enzymes else 0) <= weights.FEW and bases // digest.TILE + n <= weights.FEW // 10)
        return self._few

    def met(self, table: DataFrame | None) -> DataFrame | None:
        """Sites, gaps or tiles as the right side of a lookup: dealt out with the rows unless they are few, so that no task and
        no driver holds all of them."""
        return table if table is None or self.few else table.hint("merge")

    @property
    def tiles(self) -> DataFrame:
        return self._digested(f"tiles-{digest.TILE}-{self.overlap}", lambda new: self._cut(new, self.overlap))

    @property
    def sites(self) -> DataFrame | None:
        if not self.enzymes:
            return None
        return self._digested(f"sites-{digest.TILE}-{self._key}", lambda new: digest.cut_sites(None, self.enzymes, cut=self._cut(new, max(len(e.site) for e in self.enzymes) - 1)))

    @property
    def gaps(self) -> DataFrame | None:
        if not self.enzymes:
            return None
        return self._digested(f"gaps-{digest.TILE}-{self._key}", lambda new: digest.gaps(new, self._of(self.sites, new)))

    def _weighed(self, segments: DataFrame, settings: Settings) -> DataFrame:
        """The usable segments with their weights: those without sites, or bases, fall out."""
        check_unique(segments)
        base = segments.drop("length").join(self._index().select("seg_id", "length").where("length > 0").hint("merge"), "seg_id")
        base = base.withColumn("copy_milli", F.round(F.col("copy_number") * 1000).cast("long")).withColumn("anti_rate", F.when(F.col("linear"), 0.0).otherwise(F.col("anti_rate")))
        if settings.documented:
            base = base.withColumn("copy_milli", F.greatest(F.round(F.col("copy_milli") * F.col("abundance") * 1000).cast("long"), F.lit(0)))
        base = base.join(digest.site_counts(self.sites).hint("merge"), "seg_id") if self.enzymes else base.withColumn("n_sites", F.col("length").cast("long"))
        # Written first: a cell with very many segments is counted from its replicons, not gathered by a window.
        found = self._once("found", lambda: written(base))
        replicons = found.select("cell", "repl").distinct().groupBy("cell").agg(F.count("*").cast("int").alias("n_repl"))
        return found.join(replicons, "cell").withColumn("w_extent", F.col("copy_milli") * F.col("length")).withColumn("w_sites", F.col("copy_milli") * F.col("n_sites"))

    def placed(self, kind: str) -> DataFrame:
        """Running weights by ``extent``, or of what ``ends`` are drawn by: sites, or extent without enzymes."""
        kind = kind if self.enzymes else "extent"
        return self._whole(kind, lambda: weights.running(self.segments, "w_extent" if kind == "extent" else "w_sites"))

    def covers(self, rows: DataFrame, seg: str, pos: str, size: str) -> DataFrame:
        """Adds covered: whether a site lies in the stretch of each row. Without enzymes every base is a site."""
        if self.gaps is None:
            return rows.withColumn("covered", F.lit(True))
        return digest.in_gap(rows, self.met(self.gaps), seg, pos).withColumn("covered", digest.covers(F.col(pos), F.col(size))).drop(*digest.GAP_COLUMNS)

    def report(self) -> DataFrame:
        """One row a segment: its place in the community, length, sites, density, and share of both weights."""
        share = lambda w: (F.col(w) / self.segments.select(F.sum(w)).scalar()).alias(f"share_{w[2:]}")
        return self.segments.select("cell", "repl", "seg_id", "length", "n_sites", (F.col("n_sites") / F.col("length")).alias("density"), share("w_extent"), share("w_sites"))

    def release(self) -> None:
        """Delete the written tables that aren't kept in the store."""
        for table in self._kept.values():
            removed(table)


def prepare(segments: DataFrame, sequences: DataFrame | SequenceFiles, settings: Settings, stamp: str | None = None) -> Community:
    """Digest, then drop segments without sites; replicons and cells left without segments go with them.

    segments: seg_id, cell, repl, copy_number, linear and, optionally, anti_rate, trans_rate, abundance.
    sequences: seg_id, seq (upper case) and, optionally, linear as the segment has it, without which a join brings it there; or files of them that are cut into tiles without a whole sequence in a row. A segment that is listed twice is an error. ``stamp`` names what both are made
    from (see ``store.file_stamp``): with a known one nothing is digested, nor are sequences read.
    """
    for name, default in (("anti_rate", settings.anti_rate), ("trans_rate", settings.trans_rate), ("abundance", 1.0)):
        own = F.col(name) if name in segments.columns else F.lit(None)
        segments = segments.withColumn(name, F.coalesce(own.cast("double"), F.lit(float(default))))
    return Community(segments, sequences, settings, stamp)


def insert_draws(pairs: DataFrame, s: Settings) -> DataFrame:
    """Adds ins_len, too_short, too_long, midpoint and is_fwd to rows with idx."""
    drawn = (F.lit(float(s.insert_mean)) + F.lit(float(s.insert_sd)) * normal(s.seed, "insert", "idx")).cast("int")
    out = pairs.withColumn("__drawn", drawn).withColumn("too_short", F.col("__drawn") < s.insert_min)
    out = out.withColumn("too_long", F.lit(False) if s.insert_max is None else F.col("__drawn") > s.insert_max)
    top = F.col("__drawn") if s.insert_max is None else F.least(F.col("__drawn"), F.lit(s.insert_max))
    out = out.withColumn("ins_len", F.greatest(top, F.lit(s.insert_min))).drop("__drawn")
    return out.withColumn("midpoint", below(unit(s.seed, "midpoint", "idx"), F.col("ins_len")).cast("int")).withColumn("is_fwd", unit(s.seed, "strand", "idx") < 0.5)


_STRETCH = ("repl_lo", "repl_hi", "cell_lo", "cell_hi")
_OWN = ("seg_id", "cell", "repl", "length", "linear", "n_sites", "anti_rate", "trans_rate", "n_repl")


def _nowhere() -> Column:
    """A number below 0, where nothing is found; pairs have different ones, so that these rows are dealt out like others."""
    return -1 - F.pmod(F.col("idx"), F.lit(1 << 18))


class _Draws:
    """Lookups of one community under one set of settings."""

    def __init__(self, community: Community, s: Settings):
        self.c, self.s = community, s
        self.total, self.buckets = {}, {}
        for kind in ("extent", "ends"):
            table = community.placed(kind)
            n, total = table.agg(F.count("*"), F.max("total")).first()  # two numbers
            if not n or not total:
                raise EmptyCommunity("no segment has a base") if community.sites is None else NoCutSites("no segment has a cut site")
            if kind == "extent" and s.method == "meta3c":
                # The second end is drawn by sites: rows found by extent carry those stretches.
                table = table.drop(*_STRETCH).join(community.met(community.placed("ends").select("seg_id", *_STRETCH)), "seg_id")
            self.total[kind], self.buckets[kind] = total, weights.bucketed(table, total, n)

    def u(self, name):
        return unit(self.s.seed, name, "idx")

    def segment(self, rows: DataFrame, kind: str, x: str, end: str) -> DataFrame:
        """Adds seg<end> and its columns for the drawn number in ``x``."""
        table, width = self.buckets[kind]
        slim = table.select("bucket", "lo", "hi", *(F.col(c).alias(f"{c}{end}") for c in (*_OWN, *_STRETCH)))
        return weights.look_up(rows, slim, width, x)

    def position(self, rows: DataFrame, end: str, name: str, unless: Column | None = None) -> DataFrame:
        """Adds pos<end>, enz<end>: a random site of the segment, or any base where there are no enzymes; null ``unless``."""
        if self.c.sites is None:
            return rows.withColumn(f"pos{end}", below(self.u(name), F.col(f"length{end}"))).withColumn(f"enz{end}", F.lit(None).cast("int"))
        sites = self.c.met(self.c.sites).select(F.col("seg_id").alias("__seg"), F.col("pos").cast("long").alias(f"pos{end}"), F.col("enz").alias(f"enz{end}"), F.col("rank").alias("__rank"))
        rank = below(self.u(name), F.col(f"n_sites{end}"))
        on = (F.col(f"seg_id{end}") == F.col("__seg")) & ((rank if unless is None else F.when(unless, _nowhere()).otherwise(rank)) == F.col("__rank"))
        return rows.join(sites, on, "inner" if unless is None else "left").drop("__seg", "__rank")

    def nearest(self, rows: DataFrame, end: str, seg: str = "seg_id1") -> DataFrame:
        """Moves pos<end> to the nearest site of the segment."""
        if self.c.gaps is None:
            return rows.withColumn(f"enz{end}", F.lit(None).cast("int"))
        return self.moved(digest.in_gap(rows, self.c.met(self.c.gaps), seg, f"pos{end}"), end)

    @staticmethod
    def moved(found: DataFrame, end: str) -> DataFrame:
        """The same for rows that have met their gaps."""
        at, enz = digest.nearest(F.col(f"pos{end}"))
        return found.withColumn("__at", at).withColumn(f"enz{end}", enz).withColumn(f"pos{end}", F.col("__at").cast("long")).drop("__at", *digest.GAP_COLUMNS)

    def second_end(self, rows: DataFrame) -> DataFrame:
        """Adds kind and seg_id2, pos2, enz2 to rows with a first end."""
        kind = F.when(self.u("spurious") < self.s.spurious_rate, "spurious").when((F.col("n_repl1") > 1) & (self.u("trans") < F.col("trans_rate1")), "trans").otherwise("cis")
        stretch = {c: F.col(f"{c}1") for c in _STRETCH}
        u = self.u("seg2")
        own = stretch["repl_hi"] - stretch["repl_lo"]
        other = stretch["cell_lo"] + F.floor(u * (stretch["cell_hi"] - stretch["cell_lo"] - own))
        x = F.when(F.col("kind") == "spurious", F.floor(u * F.lit(self.total["ends"])))
        x = x.when(F.col("kind") == "trans", F.when(other < stretch["repl_lo"], other).otherwise(other + own)).otherwise(stretch["repl_lo"] + F.floor(u * own))
        rows = self.segment(rows.withColumn("kind", kind).withColumn("x2", x.cast("long")), "ends", "x2", "2")
        # Both ways in one plan: what leads to the second end would be computed for each of two.
        rows = rows.withColumn("__near", (F.col("kind") == "cis") & (F.col("seg_id1") == F.col("seg_id2")))
        free = self.position(rows, "2", "site2", unless=F.col("__near")).withColumnsRenamed({"pos2": "__pos", "enz2": "__enz"})
        both = self.constrained(free, F.col("__near"))
        chosen = {c: F.when(F.col("__near"), F.col(c)).otherwise(F.col(f"__{c[:3]}")) for c in ("pos2", "enz2")}
        return both.withColumns(chosen).drop("__near", "__pos", "__enz")

    def constrained(self, rows: DataFrame, where: Column | None = None) -> DataFrame:
        """A second end on the first one's segment, at a separation from the model; of no meaning unless ``where``."""
        n = F.col("length1")
        alpha = ALPHA_DOCUMENTED if self.s.documented else ALPHA
        delta = F.floor(inverse(self.u("separation"), n, shape=SHAPE, alpha=alpha)).cast("long")
        at = F.pmod(F.when(self.u("side") < 0.5, F.col("pos1") - F.col("__delta")).otherwise(F.col("pos1") + F.col("__delta")), n)
        # The inverse costs more than all else here: rows that don't need it have none.
        moved = rows.withColumn("__delta", delta if where is None else F.when(where, delta)).withColumn("pos2", at.cast("long")).drop("__delta")
        moved = moved.withColumn("pos2", F.when(self.u("anti") < F.col("anti_rate1"), n - F.col("pos2")).otherwise(F.col("pos2")).cast("long"))
        if self.c.gaps is None:
            return self.nearest(moved, "2")
        if where is not None:
            moved = moved.withColumn("pos2", F.when(where, F.col("pos2")).otherwise(_nowhere() * digest.TILE))
        found = digest.in_gap(moved, self.c.met(self.c.gaps), "seg_id1", "pos2")
        if self.s.method != "meta3c":
            return self.moved(found, "2")
        # The nearest site is the first one from there toward the other end, as it stands there; but a site on the last base of
        # a circle is moved to 0, where none may be: then the first one is met.
        ahead = [F.col(c).alias(f"__{c}") for c in ("first", "first_enz")]
        found = self.moved(found.select("*", *ahead), "2").withColumn("__moved", (F.col("pos2") == 0) & (F.col("__first") > 0))
        first = {"pos2": F.when(F.col("__moved"), F.col("__first").cast("long")).otherwise(F.col("pos2")), "enz2": F.when(F.col("__moved"), F.col("__first_enz")).otherwise(F.col("enz2"))}
        return found.withColumns(first).drop("__moved", "__first", "__first_enz")

    def swapped(self, rows: DataFrame) -> DataFrame:
        turn = self.u("swap") < 0.5
        cols = {}
        for c in ("seg_id", "pos", "enz", "length", "linear"):
            cols[f"{c}1"] = F.when(turn, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
            cols[f"{c}2"] = F.when(turn, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
        return rows.withColumns(cols)


_PAIR = ("idx", "mode", "kind", "ins_len", "midpoint", "is_fwd", "too_short", "too_long", "seg_id1", "pos1", "enz1", "length1", "linear1", "seg_id2", "pos2", "enz2", "length2", "linear2")


def draw_pairs(numbers: DataFrame, community: Community, s: Settings) -> DataFrame:
    """One row for each idx: mode (WGS, 3C), kind, insert, and the ends' segments, positions and enzymes."""
    d = _Draws(community, s)
    rows = insert_draws(numbers.select(F.col("idx").cast("long").alias("idx")), s)
    coin = unit(s.seed, "ligation", "idx")
    if s.method == "meta3c":
        rows = d.segment(rows.withColumn("x1", weights.anywhere(unit(s.seed, "seg1", "idx"), F.lit(d.total["extent"]))), "extent", "x1", "1")
        rows = rows.withColumn("pos1", below(unit(s.seed, "pos1", "idx"), F.col("length1")))
        seen = digest.in_gap(rows, community.met(community.gaps), "seg_id1", "pos1")
        hit = (coin < s.efficiency) & digest.covers(F.col("pos1"), F.col("midpoint"))
        rows = seen.withColumn("hit", hit)
        wgs = rows.where("NOT hit")
        ends = d.moved(rows.where("hit"), "1")
    else:
        rows = rows.withColumn("hit", coin <= s.efficiency)
        wgs = d.segment(rows.where("NOT hit").withColumn("x1", weights.anywhere(unit(s.seed, "seg1", "idx"), F.lit(d.total["extent"]))), "extent", "x1", "1")
        wgs = wgs.withColumn("pos1", below(unit(s.seed, "pos1", "idx"), F.col("length1")))
        ends = d.segment(rows.where("hit").withColumn("x1", weights.anywhere(unit(s.seed, "seg1", "idx"), F.lit(d.total["ends"]))), "ends", "x1", "1")
        ends = d.position(ends, "1", "site1")
    ends = d.swapped(d.second_end(ends)).withColumn("mode", F.lit("3C"))
    blank = {"mode": F.lit("WGS"), "kind": F.lit("wgs"), "enz1": F.lit(None).cast("int"), "seg_id2": F.lit(None).cast("string"), "pos2": F.lit(None).cast("long"), "enz2": F.lit(None).cast("int"), "length2": F.lit(None).cast("int"), "linear2": F.lit(None).cast("boolean")}
    return wgs.withColumns(blank).select(*_PAIR).unionByName(ends.select(*_PAIR))


def templates(pairs: DataFrame, community: Community, s: Settings) -> DataFrame:
    """Adds template and desc."""
    cut = community.met(community.tiles)
    one = pairs.withColumnsRenamed({"length1": "seg_id1_len", "linear1": "seg_id1_lin", "length2": "seg_id2_len", "linear2": "seg_id2_lin"})
    lig = F.col("mode") == "3C"
    one = one.withColumn("__start", F.when(lig, F.col("pos1") - F.col("midpoint")).otherwise(F.col("pos1"))).withColumn("__size", F.when(lig, F.col("midpoint")).otherwise(F.col("ins_len")))
    one = slices.take(one.withColumnRenamed("__size", "part_size"), cut, "seg_id1", "__start", "part_size", "part_a", documented=s.documented).drop("part_size")
    one = one.withColumn("part_size", F.col("ins_len") - F.col("midpoint"))
    two = slices.take(one.where(lig), cut, "seg_id2", "pos2", "part_size", "part_b", documented=s.documented)
    if s.method == "hic":
        joins = junctions(pairs.sparkSession, community.enzymes).select(F.col("enz_a").alias("enz1"), F.col("enz_b").alias("enz2"), "junction")
        two = two.join(F.broadcast(joins), ["enz1", "enz2"])  # one or four rows
    else:
        two = two.withColumn("junction", F.lit(None).cast("string"))
    two = two.withColumn("template", reads.join_parts(s.method, F.col("part_a"), F.col("part_b"), F.col("junction"), s.bridge))
    two = two.withColumn("desc", F.format_string(f"{s.method.upper()} %s:%d %s:%d", "seg_id1", "pos1", "seg_id2", "pos2"))
    whole = F.when(~F.col("is_fwd"), reverse_complement(F.col("part_a"))).otherwise(F.col("part_a")) if s.documented else F.col("part_a")
    wgs = one.where("mode = 'WGS'").withColumn("template", whole)
    wgs = wgs.withColumn("desc", F.format_string("WGS %s:%d..%d:%s", "seg_id1", "pos1", F.col("pos1") + F.col("ins_len"), F.when(F.col("is_fwd"), "F").otherwise("R")))
    keep = ["idx", "mode", "kind", "desc", "template", "too_short", "too_long"]
    return wgs.select(keep).unionByName(two.select(keep))


def simulate(numbers: DataFrame, community: Community, s: Settings, levels: DataFrame | None = None) -> DataFrame:
    """Read pairs of the pair numbers in ``numbers`` (idx): name, sequence and quality array of both reads."""
    made = templates(draw_pairs(numbers, community, s), community, s)
    if s.simple:
        made = reads.simple_reads(made, s.read_length)
    elif levels is None:
        raise ContactError("reads with errors need a quality profile")
    else:
        made = reads.error_reads(made, levels, s.read_length, s.seed, s.ins_rate, s.del_rate, documented=s.documented)
    return reads.named(made, s.prefix).drop("template")
