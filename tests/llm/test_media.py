"""Media cells: features by hand, sizes that are no multiple of a block, damage, a stored table."""
import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("contactforge.llm")
from contactforge.llm import media  # noqa: E402
from test_operators import _other_jpeg  # noqa: E402


def resized(data, width, height):
    """The same scan under a header that names other dimensions."""
    at = data.index(b"\xff\xc0")
    return data[: at + 5] + height.to_bytes(2, "big") + width.to_bytes(2, "big") + data[at + 9 :]


def plain_hash(plane):
    def cells(n):
        h, w = plane.shape
        out = np.zeros((8, n), np.int64)
        for y in range(8):
            for x in range(n):
                ys = range(y * h // 8, max((y + 1) * h // 8, y * h // 8 + 1))
                xs = range(x * w // n, max((x + 1) * w // n, x * w // n + 1))
                out[y, x] = sum(int(plane[a, b]) for a in ys for b in xs) * 1000 // (len(ys) * len(xs))
        return out

    def bits(x):
        return f"{int(''.join(map(str, x.astype(int).ravel())), 2):016x}"

    a, d = cells(8), cells(9)
    return bits(a * 64 > a.sum()) + bits(d[:, 1:] > d[:, :-1])


def test_features_by_hand(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") % 4 == 0)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in media.read_features(media.store_texts(docs)).collect():
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        plane = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.width, r.height) == (512, 8 * len(plane)) and r.feature == f"512x{8 * len(plane)}:{plain_hash(plane)}" and r.error is None
        cell = media.encode_payloads([payload])[0]
        assert (r.media_bytes, r.media_sha256) == (len(cell), hashlib.sha256(cell).hexdigest())


def test_dimensions_and_planes_of_odd_sizes():
    data, luma = _other_jpeg(2, 3, 1)  # 48 x 32 pixels in units of 16 x 16
    for width, height in ((48, 32), (47, 31), (41, 25), (40, 24), (33, 17)):
        frame = media.parse_frames(resized(data, width, height))[0]
        plane = media.thumbnails([resized(data, width, height)])[0][0]
        assert (frame.width, frame.height) == (width, height)
        assert plane.shape == (-(-height // 8), -(-width // 8)) and (plane == luma[: plane.shape[0], : plane.shape[1]]).all()


def test_damaged_cells_don_t_end_the_job(spark):
    good = media.encode_payloads([bytes(range(64)) * 3])[0]
    odd, _ = _other_jpeg(2, 3, 1)
    at = odd.index(b"\xff\xc4")
    size = int.from_bytes(odd[at + 2 : at + 4], "big")
    cells = [good, None, b"", b"\xff\xd8\xff\xc0\x00\x05\x08", good[:-30], odd[:at] + odd[at + 2 + size :], good.replace(b"\xff\xc0", b"\xff\xc2", 1), odd, resized(good, 0, 8)]
    rows = [(i, 1, c, "x") for i, c in enumerate(cells)]
    got = {r.doc_id: r for r in media.read_features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, feature string")).collect()}
    assert len(got) == len(cells)
    assert [i for i in got if got[i].error is None] == [0, 1, 7] and got[1].feature is None and got[0].payload_bytes == 192
    assert (got[7].width, got[7].height) == (48, 32) and all(got[i].feature is None and got[i].error for i in (2, 3, 4, 5, 6, 8))


def test_a_stored_table_reads_back_alike(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = media.store_texts(docs)
    made.write.parquet(str(tmp_path / "media"))
    stored = media.read_features(spark.read.parquet(str(tmp_path / "media")))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, media.read_features(made).collect()))


def test_query_reads_a_written_table(spark):
    folder = "/root/testdata/sf0.001"
    made = media.op1_media(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert not set(made.inputFiles()) & set(docs.inputFiles())
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, media.read_features(media.store_texts(docs)).collect()))
