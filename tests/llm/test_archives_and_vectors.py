"""WARC archives with damage, and nearest neighbours."""

import base64
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import ann, warc


def archive(n=6, gz=True):
    parts = []
    for i in range(n):
        block = f"<p>payload {i}</p>".encode() * 50
        raw = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")], block)
        parts.append(warc.member(raw) if gz else raw)
    return parts


def salvage(data):
    s = warc.Salvage(io.BytesIO(data))
    found = [r.headers["warc-record-id"] for r in s.records()]
    return [int(x[10:-1]) for x in found], s.gaps


def test_whole_archives():
    for gz in (True, False):
        assert salvage(b"".join(archive(gz=gz))) == ([0, 1, 2, 3, 4, 5], [])
    assert salvage(b"") == ([], [])


def test_salvage_goes_on_after_damage():
    for gz in (True, False):
        parts = archive(gz=gz)
        size = [len(p) for p in parts]
        bad = bytearray(parts[2])
        bad[len(bad) // 2] ^= 255
        ids, gaps = salvage(b"".join([*parts[:2], bytes(bad), *parts[3:]]))
        assert ids == [0, 1, 3, 4, 5] and [(a, b) for a, b, _ in gaps] == [(sum(size[:2]), sum(size[:3]))]
        ids, gaps = salvage(parts[0][: size[0] // 3] + parts[1])  # a cut record
        assert ids == [1] and gaps[0][:2] == (0, size[0] // 3)
        ids, gaps = salvage(b"junk\r\n" * 30_000 + b"".join(parts) + parts[0][:40])
        assert ids == [0, 1, 2, 3, 4, 5] and len(gaps) == 2 and gaps[0][:2] == (0, 180_000)
        assert gaps[1][1] == 180_000 + sum(size) + 40


def raw_record(i, block, extra=()):
    return warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), *extra], block)


def test_headers_of_any_length():
    long = [("X-Long", "v" * 70_000), ("X-Longer", "w" * 200_000)]
    parts = [raw_record(i, b"block %d" % i, long) for i in range(3)]
    for whole in (b"".join(parts), b"".join(map(warc.member, parts))):
        assert salvage(whole) == ([0, 1, 2], [])
    assert salvage(b"x" * 10 + b"".join(parts))[0] == [0, 1, 2]


def test_a_member_of_many_records():
    parts = [raw_record(i, b"block %d " % i * 40_000) for i in range(5)]
    assert salvage(warc.member(b"".join(parts))) == ([0, 1, 2, 3, 4], [])
    bad = parts[2].replace(b"Content-Length: ", b"Content-Length: 9")
    packed = warc.member(b"".join([*parts[:2], bad, *parts[3:]]))
    ids, gaps = salvage(packed + warc.member(parts[0]))
    a = sum(map(len, parts[:2]))
    assert ids == [0, 1, 3, 4, 0]
    assert [(x, y) for x, y, _ in gaps] == [(0, len(packed))] and f"bytes {a} to {a + len(bad)} of" in gaps[0][2]
    # a member that fails its checksum gives only records that prove themselves
    sure = [raw_record(i, b"%d" % i * 9000, [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(b"%d" % i * 9000).digest()).decode())]) for i in range(3)]
    for group, want in ((sure, [0, 1]), (parts[:3], [])):
        cut = bytearray(warc.member(b"".join(group)))
        cut[-5] ^= 255
        ids, gaps = salvage(bytes(cut))
        assert ids == want and gaps[0][:2] == (0, len(cut))
    wrong = raw_record(7, b"abc", [("WARC-Block-Digest", "sha1:" + "A" * 32)])
    assert salvage(wrong + parts[0])[0] == [0]


def test_a_gap_in_own_archives_is_an_error(spark, tmp_path, monkeypatch):
    written = warc.write_archives

    def damaged(pages, folder):
        paths = written(pages, folder)
        system, path = warc.open_fs(paths[0])
        with system.open_input_file(path) as f:
            data = bytearray(f.read())
        data[40] ^= 255
        with system.open_output_stream(path) as f:
            f.write(bytes(data))
        return paths

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(RuntimeError, match="from byte"):
        warc.op4_warc(spark, "/root/testdata/sf0.001")


def test_hot_digests_without_a_broadcast(spark, monkeypatch):
    rows = [(i, "u", "x" * 200 if i % 3 else f"{i} " * 60) for i in range(3000)] + [(5000 + i, "u", f"{i * 3} " * 60) for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((r.page_id, r.first) for r in warc.plan_records(pages).collect())
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(((r.page_id, r.first) for r in warc.plan_records(pages).collect())) == want
    assert sum(f is not None for _, f in want) == 1999 + 500


def test_pages_round_trip(spark, tmp_path):
    long, other = "x" * 100, "é" * 60
    rows = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (1, "u\r\nv", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (None, "u", long), (3, "http://b", long)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    paths = warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.followed(warc.read_archives(spark, paths)).collect()
    assert len(got) == len(rows) and not any(r.gap for r in got)
    body = dict((r[0], (r[2] or "").encode()) for r in rows)
    first = {3: None, 5: 3, 9: 3, None: 3, 7: None, 8: 7}
    for r in got:
        p = body[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        assert r.refers_to == first.get(r.page_id)
        assert r.record_type == ("response" if first.get(r.page_id) is None else "revisit")
        assert bytes(r.block) == (p if r.record_type == "response" else b"")
    # damage one archive: the gap is a row, the others stay
    data = bytearray(open(paths[0], "rb").read())
    data[30] ^= 255
    open(paths[0], "wb").write(bytes(data))
    again = warc.read_archives(spark, paths).collect()
    assert sum(r.gap is not None for r in again) == 1 and sum(r.gap is None for r in again) == len(rows) - 1
    assert warc.write_archives(pages.limit(0), str(tmp_path / "none")) == []
    assert warc.read_archives(spark, []).count() == 0


def plain_nearest(rows, top):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and i is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-ann.exact_score(v, w), j) for j, w in {j: w for j, w in good if len(w) == len(v)}.items() if j != i)[:top]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_nearest_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(1000, 1060)]  # copies of a query's vector
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [1.0] * 7 + [None]), (480, [float("nan")] + [1.0] * 7), (500, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (20, rows[20][1]), (520, [1.0, 2.0]), (521, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 20 == 0, top=20, block=100, group=7).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == plain_nearest(rows, 20)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_of_a_large_block(scaled):
    """A whole block of random vectors, the hardest case: few are scored, nine in ten are found."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(ann.BLOCK, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if scaled:
        v *= rng.uniform(0.2, 1, (len(v), 1))
    q, hit, seen = v[:200], 0, []
    plain = ann.Forest.candidates

    def counted(self, *args):
        seen.append(len(plain(self, *args)))
        return plain(self, *args)

    ann.Forest.candidates = counted
    try:
        for k, found, scores in ann.search(v, q, 21):
            best = set(np.argsort(-(v @ q[k]))[:21].tolist())
            hit += len(best & set(found.tolist()))
    finally:
        ann.Forest.candidates = plain
    assert hit / (200 * 21) >= 0.96 and np.mean(seen) <= 0.08 * ann.BLOCK


def test_ascent_widens_to_everything():
    rng = np.random.default_rng(3)
    forest = ann.Forest(rng.normal(size=(50, 6)), trees=5, bits=16)
    lo, hi = forest.ranges(rng.normal(size=(3, 6)), 10**9)
    assert (lo == 0).all() and (hi == 50).all() and len(forest.candidates(lo[0], hi[0], 50)) == 50
    lo, hi = forest.ranges(rng.normal(size=(3, 6)), 10)
    assert ((hi - lo).sum(axis=1) >= 10).all() and len(forest.candidates(lo[0], hi[0], 2)) >= 2
