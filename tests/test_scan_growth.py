"""Steps whose memory or work must not grow faster than the input."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import SMALL
from test_cutters import plain

from contactforge.operators import cutters, scan
from contactforge.plans.queries import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_scan_of_a_large_batch():
    """Memory goes by the bases that are scanned at once, not by the rows of a batch."""
    text = np.random.default_rng(1).choice(np.frombuffer(b"ACGT", np.uint8), 4106).tobytes().decode()
    n = 2000
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * n), pa.array([True] * n), pa.array([4096 * n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([text] * n)], ["seg_id", "linear", "length", "tile", "part"])
    run = scan._scan(scan.Scanner([scan.Pattern(0, "GATC", 0)]), 4096)
    tracemalloc.start()
    found = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * text[:4099].count("GATC") and most < 60e6


def test_sites_of_both_strands_are_not_gathered(spark):
    """One cut by both strands is listed once by a rule that a tile decides alone, across cuts of tiles and the origin."""
    assert "HashAggregate" not in _plan(QUERIES["site_scan_all"](spark, SMALL))
    r = random.Random(3)
    names = ["MmeI", "BsaI", "MlyI", "EcoP15I", "DpnII"]
    both = {"MlyI": "GAGTC" + "A" * 10 + "GACTC", "EcoP15I": "CAGCAG" + "T" * 52 + "CTGCTG", "BsaI": "GGTCTC" + "C" * 6 + "GAGACC"}
    seqs = []
    for k in range(120):
        n = r.choice([30, 70, 97, 101, 106, 125, 160, 192, 193, 300])
        s = "".join(r.choice("ACGT") for _ in range(max(0, n - 64))) + r.choice(list(both.values()))
        cut = r.randrange(len(s))
        seqs.append((f"s{k}", s[cut:] + s[:cut], k % 3 == 0))
    df = spark.createDataFrame(seqs, "seg_id string, seq string, linear boolean")
    got = {}
    for row in cutters.all_sites(df, names, tile=96).collect():
        got.setdefault(row.seg_id, []).append((row.pos, row.enz))
    for name, s, linear in seqs:
        found = got.get(name, [])
        assert len(found) == len(set(found)) and set(found) == plain(s, linear, names), (name, len(s), linear)
