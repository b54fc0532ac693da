"""Profiles in TOML that are read line by line."""
import logging

import pytest

from contactforge.errors import ContactError
from contactforge.sources import profile

TEXT = """profile_version = "1"  # of the layout

[community]
spurious_rate = 0.04

[[community.cells]]
name = "a # b"
abundance = 2.5E-1
trans_rate = 0.3
[[community.cells.replicons]]
name = "r"
copy_number = 2
segments = [
  "s \\"1\\"",
  's2', "s3",
]
[[community.cells.replicons]]
name = "q"
copy_number = 1
anti_rate = 0.0
linear = true
segments = ["s4"]

[[community.cells]]
name = "c"
abundance = 3
[[community.cells.replicons]]
name = "r"
copy_number = 4
segments = [ "s5",
  "s6" ]
[[community.cells]]
name = "a # b"
abundance = 9
[[community.cells.replicons]]
name = "r"
copy_number = 7
segments = ["s7", "s8"]
"""


@pytest.mark.parametrize("normalise", [False, True])
def test_lines_equal_the_whole(spark, tmp_path, normalise, monkeypatch):
    """In splits of a few lines, with headings that are splits away; the first of repeated cells and replicons counts."""
    (tmp_path / "p.toml").write_text(TEXT)
    want, rate = profile.read_toml(spark, TEXT, normalise, linear=False)
    want = sorted(map(str, want.collect()))
    for size in ("40", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "40" else "4m")
        try:
            got, own = profile.read_toml_lines(spark, str(tmp_path / "p.toml"), normalise)
            assert sorted(map(str, got.collect())) == want and own == rate == 0.04
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_refused(spark, tmp_path, caplog):
    (tmp_path / "e.toml").write_text("x = 1\n")
    with caplog.at_level(logging.WARNING), pytest.raises(ContactError):
        profile.read_toml_lines(spark, str(tmp_path / "e.toml"))
    (tmp_path / "m.toml").write_text(TEXT.replace('name = "c"', 'name = """\nc"""'))
    with pytest.raises(Exception, match="bad profile"):
        profile.read_toml_lines(spark, str(tmp_path / "m.toml"))[0].collect()
