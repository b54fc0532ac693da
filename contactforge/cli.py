"""Command line: simulate read pairs from sequences and a community profile."""
from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import ContactError
from .operators.reads import summary
from .plans.experiment import METHODS, Settings, prepare, simulate
from .sinks.records import output_kind, write_profile, write_reads
from .sinks.restart import write_ranges
from .sources import fasta, profile, quality, tiled
from .storage import removed
from .store import file_stamp

VERSION = "0.2"
#: Rows of a procedural profile that are shown; the file has all.
SHOWN = 1000
log = logging.getLogger("contactforge")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contactforge", description=__doc__)
    p.add_argument("-V", "--version", action="version", version=VERSION)
    p.add_argument("-v", "--verbose", action="store_true", help="say more")
    p.add_argument("--convert", action="store_true", help="turn ambiguous symbols into N")
    p.add_argument("-r", "--seed", type=int, default=int(time.time()), help="seed of all draws")
    p.add_argument("-m", "--method", choices=sorted(METHODS), default="hic")
    p.add_argument("-e", "--enzyme", action="append", default=[], help="enzyme name; twice for two")
    p.add_argument("-n", "--num-pairs", type=int, required=True)
    p.add_argument("-l", "--read-length", type=int, required=True)
    p.add_argument("--prefix", default="SIM", help="of read names")
    p.add_argument("--insert-mean", type=int, default=400)
    p.add_argument("--insert-sd", type=int, default=50)
    p.add_argument("--insert-min", type=int, default=100)
    p.add_argument("--insert-max", type=int)
    p.add_argument("--bridge-adapter", help="sequence between the two parts (dnase)")
    p.add_argument("--linear", action="store_true", help="all replicons are linear")
    p.add_argument("--efficiency", type=float)
    p.add_argument("--anti-rate", type=float, default=0.2)
    p.add_argument("--trans-rate", type=float, default=0.1)
    p.add_argument("--spurious-rate", type=float, default=0.02)
    p.add_argument("-P", "--profile", help="community profile")
    p.add_argument("--profile-name", default="profile.tsv", help="where a procedural profile is written")
    p.add_argument("--profile-format", choices=["table", "toml"], default="table")
    p.add_argument("--dist", choices=["equal", "uniform", "lognormal"], help="procedural profile")
    p.add_argument("--lognorm-mu", type=float, default=1.0)
    p.add_argument("--lognorm-sigma", type=float, default=1.0)
    p.add_argument("--simple-reads", action="store_true", help="no sequencing errors")
    p.add_argument("--machine-profile", default=quality.PARAMETRIC, choices=[quality.PARAMETRIC, *quality.MACHINES])
    p.add_argument("--machine-folder", default=".", help="folder of the machine profile's two files")
    p.add_argument("--ins-rate", type=float, default=9e-5)
    p.add_argument("--del-rate", type=float, default=1.1e-4)
    p.add_argument("--folders", action="store_true", help="leave outputs as folders of parts, for other Spark jobs")
    p.add_argument("--restart", metavar="FOLDER", help="keep finished ranges of pairs there; the same command with the same seed continues a lost run")
    p.add_argument("--ranges", type=int, default=16, help="ranges of a run with --restart")
    p.add_argument("--overwrite", action="store_true", help="replace an existing profile file")
    p.add_argument("--documented", action="store_true", help="follow the model's description where practice differs")
    p.add_argument("sequences", help="FASTA")
    p.add_argument("output", help="reads: R1, or both interleaved")
    p.add_argument("output2", nargs="?", help="reads: R2")
    return p


def community(spark: SparkSession, a: argparse.Namespace, sequences):
    """(segments, spurious rate) from the profile asked for, or every sequence as a cell of its own."""
    if a.profile and a.dist:
        raise ContactError("a profile and --dist exclude each other")
    if a.profile and a.profile_format == "toml":
        text = "\n".join(r[0] for r in spark.read.text(a.profile, wholetext=True).collect())
        segments, spurious = profile.read_toml(spark, text, True, a.trans_rate, a.anti_rate, a.linear)
        return segments, a.spurious_rate if spurious is None else spurious
    if a.profile:
        return profile.read_table(spark, a.profile, True).withColumn("linear", F.lit(a.linear)), a.spurious_rate
    names = sequences.select(F.col("seg_id").alias("name"))
    made = profile.distribute(names, a.dist or "equal", a.seed, a.lognorm_mu, a.lognorm_sigma)
    made = made.select(F.col("name").alias("seg_id"), F.col("name").alias("cell"), F.col("name").alias("repl"), "abundance", F.lit(1.0).alias("copy_number"))
    if a.dist:
        write_profile(made, a.profile_name, overwrite=a.overwrite)
        for line in profile.table_rows(made).orderBy("ord").limit(SHOWN).select("line").collect():
            print(line[0])
    return made.withColumn("linear", F.lit(a.linear)), a.spurious_rate


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    log.info("contactforge %s at %s: %s", VERSION, time.strftime("%Y-%m-%dT%H:%M:%S%z"), " ".join(sys.argv[1:] if argv is None else argv))
    try:
        output_kind(a.output, a.output2)
        if a.restart and a.folders:
            raise ContactError("--restart joins its ranges: --folders excludes it")
        spark = spark or SparkSession.builder.appName("contactforge").getOrCreate()
        settings = Settings(
            method=a.method, enzymes=a.enzyme, seed=a.seed, read_length=a.read_length, prefix=a.prefix, insert_mean=a.insert_mean, insert_sd=a.insert_sd,
            insert_min=a.insert_min, insert_max=a.insert_max, efficiency=a.efficiency, anti_rate=a.anti_rate, trans_rate=a.trans_rate,
            spurious_rate=a.spurious_rate, bridge=a.bridge_adapter, simple=a.simple_reads, ins_rate=a.ins_rate, del_rate=a.del_rate, documented=a.documented,
        )
        source = tiled.opened(spark, a.sequences, a.convert, some=bool(a.profile))
        names = source.lengths()
        segments, settings.spurious_rate = community(spark, a, names)
        fasta.check_unique(segments)
        fasta.check_known(segments, names)
        levels = None
        if not a.simple_reads and a.machine_profile == quality.PARAMETRIC:
            levels = quality.parametric(spark, a.read_length)
        elif not a.simple_reads:
            first, second = quality.profile_files(a.machine_profile, a.machine_folder)
            levels = quality.levels(quality.read_profile(spark, first), quality.read_profile(spark, second), a.read_length)
        # What the community is made from: with the same files and options, a store that is kept has it already.
        given = file_stamp(spark, a.profile, a.profile_format) if a.profile else (a.dist, a.seed, a.lognorm_mu, a.lognorm_sigma)
        made = prepare(segments, source, settings, f"{source.stamp} {given} {a.linear}")
        numbers = spark.range(1, a.num_pairs + 1).withColumnRenamed("id", "idx")
        if a.restart:
            key = {k: v for k, v in vars(a).items() if k not in ("verbose", "restart", "overwrite", "output", "output2")} | {"stamp": source.stamp, "profile": given}
            counts = write_ranges(spark, lambda part: simulate(part, made, settings, levels), a.num_pairs, a.output, a.output2, a.restart, key, a.ranges)
        else:
            held = write_reads(simulate(numbers, made, settings, levels), a.output, a.output2, not a.folders)
            counts = summary(held).first().asDict()
            removed(held)
        print("pairs: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
        made.release()
    except ContactError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
