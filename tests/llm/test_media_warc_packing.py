import gzip
import hashlib
import io
import itertools
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import media, packing, warc
from docloom.llm.common import Scratch


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_round_trip(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 19), np.uint8)
    assert np.array_equal(media.decode_png(media.encode_png(pixels, kind, idat=50)), pixels)


def plain_unfilter(rows, bpp):
    """Pixel by pixel, as the format defines it."""
    out = []
    for y, (kind, *line) in enumerate(rows.tolist()):
        up, done = out[y - 1] if y else [0] * len(line), []
        for i, v in enumerate(line):
            a, b, c = done[i - bpp] if i >= bpp else 0, up[i], up[i - bpp] if i >= bpp else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda x: abs(p - x))
            done.append((v + [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(done)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("bpp", [1, 3, 4])
def test_mixed_filters_are_undone(bpp):
    rng = np.random.default_rng(bpp)
    for _ in range(5):
        rows = rng.integers(0, 256, (rng.integers(1, 25), 1 + 7 * bpp), np.uint8)
        rows[:, 0] = rng.integers(0, 5, len(rows))
        assert np.array_equal(media.unfilter(rows, bpp), plain_unfilter(rows, bpp))


def test_stored_rows_are_filtered():
    text = b"some prose that goes on, with letters near each other. " * 200
    pixels = np.frombuffer(media.payload(text), np.uint8).reshape(-1, media.WIDTH)
    kinds = media.best_rows(pixels)[:, 0]
    assert set(kinds) <= {0, 1, 2} and (kinds > 0).mean() > 0.9
    assert np.array_equal(media.decode_png(media.encode_png(pixels)), pixels)


def test_hash_matches_a_plain_transform():
    rng = np.random.default_rng(3)
    for height in (1, 3, 40):
        pixels = rng.integers(0, 256, (height, media.WIDTH), np.uint8)
        tall = np.repeat(pixels.astype(float), 32, axis=0)  # 32 areas of ``height`` rows each
        small = tall.reshape(32, height, 32, media.WIDTH // 32).mean(axis=(1, 3))
        low = [sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        middle = sorted(round(v, 6) for v in low[1:])[31]
        bits = "".join(str(int(round(v, 6) > middle)) for v in low)
        assert media.cosine_hash(pixels) == f"{int(bits, 2):016x}"


def test_png_checks():
    blob = bytearray(media.encode_png(np.zeros((3, 5), np.uint8)))
    for change in (lambda b: b[:-3], lambda b: b"x" + b[1:], lambda b: b[:40] + bytes([b[40] ^ 1]) + b[41:]):
        with pytest.raises(ValueError):
            media.decode_png(bytes(change(bytes(blob))))


def test_cosine_hash_is_of_low_frequencies():
    rng = np.random.default_rng(0)
    x = media._cosines(64, 8).T @ rng.normal(size=(8, 8)) @ media._cosines(media.WIDTH, 8)
    noisy = x + rng.normal(0, 0.1, x.shape)
    apart = lambda a, b: bin(int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).count("1")
    assert apart(x, noisy) <= 4 and media.cosine_hash(x) == media.cosine_hash(x.copy())


def test_media_columns_match_brute_force(spark, odd, empty):
    stored = Scratch(spark, "t").keep(media.text_to_png(odd), compression="none")
    blobs = {r.id: r.media for r in stored.collect()}
    for r in media.png_features(stored).collect():
        text = (dict((i, t) for i, t in odd.select("doc_id", "text").collect())[r.id] or "").encode()
        data = text + b"\xff" * (-len(text) % 576 or (0 if text else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256, len(r.feature)) == (len(blobs[r.id]), hashlib.sha256(blobs[r.id]).hexdigest(), 16)
    assert media.png_features(media.text_to_png(empty)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(wide):
    members = [("a.txt", b"abc"), ("dir/b.bin", bytes(1000)), ("empty", b"")]
    blob = warc.write_zip(members, zip64=wide)
    assert {i.filename: zipfile.ZipFile(io.BytesIO(blob)).read(i) for i in zipfile.ZipFile(io.BytesIO(blob)).infolist()} == dict(members)
    read = lambda at, n: blob[at : at + n]
    for name, m in warc.zip_directory(read, len(blob)).items():
        start = warc.member_start(read, m)
        assert blob[start : start + m.size] == dict(members)[name]
    with pytest.raises(ValueError):
        warc.zip_directory(read, 10)


def test_zip_reader_refuses_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 100)
    read = lambda at, n: out.getvalue()[at : at + n]
    with pytest.raises(ValueError, match="stored"):
        warc.member_start(read, warc.zip_directory(read, len(out.getvalue()))["x"])


def test_warc_matches_brute_force(spark):
    rows = [(i, "http://x/ y\n", html, "z", 1) for i, html in [(1, "a" * 1000), (2, "a" * 1000), (9, "a" * 1000), (3, "a" * 999), (4, "a" * 999), (5, None), (6, None), (7, "é" * 500), (8, "é" * 500), (10, "b" * 2000), (10, "b" * 2000), (None, "a" * 1000)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, response_id int").select("page_id", "url", "html")
    scratch = Scratch(spark, "t")
    archives = scratch.keep(warc.write_archives(pages, scratch.keep(warc.revisits(pages)), scratch.root + "/zip", archive_bytes=200))
    assert archives.agg(F.sum("records")).first()[0] == 12 and archives.count() > 3
    found = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()}
    assert found == {(1, 1000, "revisit", 9), (2, 1000, "revisit", 9), (9, 1000, "response", None), (3, 999, "response", None), (4, 999, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 1000, "revisit", 8), (8, 1000, "response", None), (10, 2000, "response", None), (None, 1000, "revisit", 9)}
    assert warc.read_archives(warc.write_archives(pages.where("false"), warc.revisits(pages), scratch.root + "/none")).count() == 0


def test_warc_reads_files_by_range(spark, tmp_path):
    """Packages of other writers, 64-bit records among them; reads stay within the records."""
    record = lambda i: gzip.compress(warc.warc_record(i, "http://x", b"hello", hashlib.sha1(b"hello").hexdigest(), None))
    members = [record(i) for i in range(150)]
    blob = warc.build_archive([("http://x", m) for m in members])
    directory = warc.zip_directory(lambda at, n: blob[at : at + n], len(blob))
    parts = [(name, blob[(at := warc.member_start(lambda at, n: blob[at : at + n], m)) : at + m.size]) for name, m in directory.items()]
    (tmp_path / "plain.zip").write_bytes(blob)
    (tmp_path / "wide.wacz").write_bytes(warc.write_zip([("first.txt", b"x" * 5000), *parts], zip64=True))
    paths = spark.createDataFrame([(str(tmp_path / "plain.zip"),), ("file://" + str(tmp_path / "wide.wacz"),)], "path string")
    got = warc.read_archives(paths).collect()
    assert sorted(r.page_id for r in got) == sorted([*range(150)] * 2)
    assert {(r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == {(5, hashlib.sha1(b"hello").hexdigest(), "response", None)}
    reads = []
    blob = (tmp_path / "wide.wacz").read_bytes()
    entries = list(warc.index_entries(lambda at, n: reads.append(n) or blob[at : at + n], len(blob)))
    assert [n for _, n in entries] == [len(m) for m in members] and len(reads) <= 7


def padding(counts, bounds):
    return sum(n * (min(b for b in bounds if b >= k) - k) for k, n in counts.items() if k)


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        lengths = sorted(k for k in counts if k)
        bounds = packing.optimal_boundaries(counts, 3)
        if not lengths:
            assert bounds == []
            continue
        best = min(padding(counts, [*c, lengths[-1]]) for k in range(3) for c in itertools.combinations(lengths[:-1], k))
        assert bounds[-1] == lengths[-1] and len(bounds) <= 3 and padding(counts, bounds) == best


def test_packing_keeps_everything(spark, odd, empty):
    scratch = Scratch(spark, "t")
    rows = packing.pack(odd, scratch, max_len=1000, token_budget=3000, buckets=3).collect()
    assert sum(r.length for r in rows) == 30_000 + 3 * 6 + 5 + 2
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r.bucket, r.batch or 0)), key=lambda r: (r.bucket, r.batch)):
        group = list(group)
        assert len(group) * group[0].boundary <= 3000 or len(group) == 1 or key[1] is None
        assert all(r.length <= r.boundary for r in group)
    assert packing.pack(empty, scratch).count() == 0


def test_full_batches_whatever_the_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    sizes = [r["count"] for r in packing.pack(df, Scratch(spark, "t"), token_budget=40).groupBy("bucket", "batch").count().collect()]
    assert sizes == [10] * 50
