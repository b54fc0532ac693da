"""Indexes of sequence files."""
from contactforge.sources import tiled


def test_records_are_handed_on_together():
    rows = [(str(k), k) for k in range(1200)]
    got = list(tiled._batched(lambda batches: iter(rows), "name string, at long")(iter([])))
    assert [b.num_rows for b in got] == [512, 512, 176] and [tuple(x.values()) for b in got for x in b.to_pylist()] == rows
