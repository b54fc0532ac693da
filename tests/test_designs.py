"""A table of designs is judged as each one alone."""
from conftest import SMALL
from pyspark.sql import functions as F

from contactforge.errors import ContactError
from contactforge.plans import designs, queries
from contactforge.plans.experiment import METHODS, Settings


def test_designs_agree_with_settings(spark):
    rows = designs.checked(queries.design_rows(spark, SMALL).withColumn("given", F.col("efficiency"))).collect()
    seen = set()
    for r in rows:
        try:
            s = Settings(method=r.method, enzymes=["DpnII", "HinfI", "MseI"][: r.n_enzymes], bridge=r.bridge, insert_min=r.insert_min, insert_mean=r.insert_mean, insert_sd=r.insert_sd, insert_max=r.insert_max, read_length=r.read_length, efficiency=r.given)
            said = None
            assert s.efficiency == r.efficiency
        except ContactError as e:
            said = "unknown method" if "unknown method" in str(e) else str(e)
        assert r.problem == said, r
        seen.add(said)
    assert len(seen) == 1 + len(designs.problems()) and METHODS["hic"] == 0.5
