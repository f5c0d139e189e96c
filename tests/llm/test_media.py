import hashlib
import io
import zlib

import numpy as np
import pytest

from tapeloom.llm import media

RNG = np.random.default_rng(4)


def test_formats_round_trip():
    grey, colour = RNG.integers(0, 256, (13, 7), np.uint8), RNG.integers(0, 256, (5, 9, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_ppm(colour)) == colour).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()


def test_plain_and_bitmap_netpbm():
    assert media.decode(b"P2 # note\n3 1\n15\n0 15 5\n").tolist() == [[0, 255, 85]]
    assert media.decode(b"P1\n3 2\n101 0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    with pytest.raises(ValueError):
        media.decode(b"P5\n9 9\n255\nabc")


def test_area_resize_is_the_mean_of_each_cell():
    x = RNG.integers(0, 256, (30, 18), np.uint8)
    assert np.allclose(media.area_resize(x, 5, 6), x.reshape(5, 6, 6, 3).mean(axis=(1, 3)))
    fine = np.kron(x, np.ones((7, 11)))  # a fractional cut equals the whole cut of a finer grid
    assert np.allclose(media.area_resize(x, 7, 11), fine.reshape(7, 30, 11, 18).mean(axis=(1, 3)))
    assert np.load(io.BytesIO(media.npy_tile(x, 4))).shape == (4, 4)


def test_difference_hash_sees_slopes():
    rising = np.tile(np.arange(90, dtype=np.uint8), (40, 1))
    assert media.difference_hash(rising) == "f" * 16 and media.difference_hash(rising[:, ::-1]) == "0" * 16


def test_texts_survive_storage(make_docs, odd_rows):
    got = media.stored_text_media(make_docs(odd_rows)).collect()
    raw = sorted((repr(d), (t or "").encode()) for d, t in odd_rows)
    assert len(got) == len(raw)
    for g, (_, text) in zip(sorted(got, key=lambda r: (repr(r.id), r.n_bytes)), sorted(raw, key=lambda r: (r[0], len(r[1])))):
        n = max(1, -(-len(text) // 576)) * 576
        payload = text.ljust(n, b"\xff")
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256) == (len(text), n, hashlib.sha256(payload).hexdigest())
        assert g.tail_crc32 == zlib.crc32(payload[-32:])
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 576)
        stored = media.encode_pgm(pixels)
        assert (g.media_bytes, g.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert g.feature == media.difference_hash(pixels)


def test_undecodable_and_missing_media(spark):
    rows = [(1, None), (2, bytearray(b"GIF89a")), (3, bytearray(media.encode_bmp(np.zeros((2, 2), np.uint8))))]
    got = {r.id: r for r in media.media_features(spark.createDataFrame(rows, "id long, media binary"), keep=("id",)).collect()}
    assert got[1].media_bytes is None and got[2].media_bytes == 6 and got[2].feature is None
    assert (got[3].height, got[3].width) == (2, 2)
    assert media.stored_text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
