"""SimHash fingerprints and their near-duplicate groups by vantage-point trees.

A fingerprint has 64 bits; two documents are linked where at most ``RADIUS`` bits
differ, and groups are the connected components.  The links are exact: a
vantage-point tree over the distinct fingerprints deals them to shards, and a
fingerprint within reach of a boundary goes to both sides, so every linked pair
meets in some shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, with_least
from ._util import hot_join, keep_named, mapped, materialize, text_key, worker_state

#: Fixed by the definition of the fingerprint.
SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints aimed at in a shard, and drawn to place the vantage points.
SHARD_SIZE, SAMPLE = 16_384, 20_000


def lanes_of_bytes() -> np.ndarray:
    """For each byte, its eight bits as eight byte-wide counters in one word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)[:, 0]


def fingerprint_of(text: str | None, lanes: np.ndarray) -> int:
    """64-bit SimHash of one text, as a signed integer; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII white space, ASCII letters
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=">u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        first = [0, *(ends[: n - SHINGLE_WORDS] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(first, ends[SHINGLE_WORDS - 1 :].tolist())], dtype=">u8"
        )
    return bits_of(hashes, lanes)


def bits_of(hashes: np.ndarray, lanes: np.ndarray) -> int:
    """The fingerprint of these 64-bit shingle hashes; 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    octets = hashes.astype(">u8", copy=False).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(octets), 255):  # a lane holds 255 at most
        counts += lanes[octets[i : i + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > len(octets)).view(">i8")[0])


def _fingerprint_batches(batches):
    worker_state("simhash")
    lanes = lanes_of_bytes()
    for batch in batches:
        found = pa.array([fingerprint_of(t.as_py(), lanes) for t in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "k", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, k, fp)``, one row per row of ``docs(doc_id, text)``; k is the text's MD5."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k"), "text")
    return mapped(named, _fingerprint_batches, "doc_id long, k string, fp long")


def build_tree(sample: np.ndarray, levels: int, radius: int, seed: int = 1) -> list | None:
    """Top levels of a vantage-point tree: [vantage, threshold, near, far] or None.

    The vantage point is, of a few candidates, the one whose best threshold
    copies the fewest fingerprints over the boundary.
    """
    rng = np.random.default_rng(seed)

    def grow(points: np.ndarray, depth: int):
        if depth == 0 or len(points) < 64:
            return None
        best = None
        for v in rng.choice(points, size=8):
            d = np.bitwise_count(points ^ v)
            upto = np.cumsum(np.bincount(d, minlength=65))
            near = upto[:64]  # with threshold t: d <= t
            far = len(points) - np.concatenate([np.zeros(radius, np.int64), upto[: 64 - radius]])  # d > t - radius
            t = int(np.argmin(np.maximum(near, far)))
            worst = max(near[t], far[t])
            if best is None or worst < best[0]:
                best = (worst, int(v), t, d)
        worst, v, t, d = best
        if worst > 0.9 * len(points):  # too dense to part
            return None
        return [v, t, grow(points[d <= t], depth - 1), grow(points[d > t - radius], depth - 1)]

    return grow(sample, levels)


def route(points: np.ndarray, tree, radius: int, path: int = 1):
    """Yield (shard, positions of points): near takes d <= t; far takes d > t - radius.

    Where one of a linked pair is near and the other far, the triangle bound puts
    the near one within ``radius`` of the boundary, so it was copied to the far side.
    """

    def walk(at: np.ndarray, node, path: int):
        if node is None:
            yield path, at
            return
        v, t, near, far = node
        d = np.bitwise_count(points[at] ^ np.uint64(v)).astype(np.int64)
        yield from walk(at[d <= t], near, 2 * path)
        yield from walk(at[d > t - radius], far, 2 * path + 1)

    yield from walk(np.arange(len(points)), tree, path)


def link_points(points: np.ndarray, radius: int = RADIUS, leaf: int = 512) -> np.ndarray:
    """For distinct points, the position of each one's group representative.

    A local vantage-point tree parts the points; leaves compare all their pairs
    in blocks and keep spanning links only.
    """
    parent = np.arange(len(points))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(a, b):
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    def compare(at: np.ndarray):
        own = points[at]
        for lo in range(0, len(own), 256):
            rows = own[lo : lo + 256]
            hit = np.bitwise_count(rows[:, None] ^ own[None, lo:]) <= radius
            first = hit.argmax(axis=0)  # of each column, a row that it is linked to
            r, c = np.nonzero(hit)
            keep = r + 0 != c
            r, c = r[keep], c[keep]
            if len(r):
                both = np.unique(r * len(rows) + first[c])  # rows linked by a common column
                union(at[lo + both // len(rows)], at[lo + both % len(rows)])
                union(at[lo + first[np.unique(c)]], at[lo + np.unique(c)])

    rng = np.random.default_rng(2)

    def part(at: np.ndarray):
        if len(at) <= leaf:
            return compare(at)
        own = points[at]
        v = own[rng.integers(len(own))]
        d = np.bitwise_count(own ^ v)
        upto = np.cumsum(np.bincount(d, minlength=65))
        near = upto[:64]
        far = len(own) - np.concatenate([np.zeros(radius, np.int64), upto[: 64 - radius]])
        t = int(np.argmin(near.astype(float) ** 2 + far.astype(float) ** 2))
        if near[t] ** 2 + far[t] ** 2 > 0.95 * len(own) ** 2:  # pruning gains nothing here
            return compare(at)
        part(at[d <= t])
        part(at[d > t - radius])

    part(np.arange(len(points)))
    return np.array([find(i) for i in range(len(points))], dtype=np.int64)


def levels_for(n: int, shard_size: int) -> int:
    """Levels after which shards of ``n`` points hold about ``shard_size``."""
    return max(0, int(np.ceil(np.log(max(1, n / shard_size)) / np.log(1 / 0.635))))


def deal_shards(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, sample: int = SAMPLE) -> DataFrame:
    """``(shard, fp)``: every pair within ``radius`` of the distinct ``(fp)`` meets in a
    shard, and no shard holds more than twice ``shard_size`` rows.

    The first tree is placed by a sample of the whole; shards that come out too
    large are parted again by trees placed by samples of their own (one task a
    shard), round by round.  A shard too dense to be parted by any tree is cut into
    blocks, whose pairs of blocks become shards.
    """
    most = 2 * shard_size
    n = distinct.count()
    if n <= most:
        return distinct.select(F.lit("").alias("shard"), "fp")
    now, done, sizes = distinct.select(F.lit("").alias("shard"), "fp"), None, {"": n}
    while sizes:
        share = F.element_at(F.create_map(*[F.lit(x) for k, m in sizes.items() for x in (k, min(1.0, sample / m))]), F.col("shard"))

        def plant(key, table):
            import pickle

            shard = key[0].as_py()
            points = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            tree = build_tree(np.sort(points), levels_for(sizes[shard], shard_size), radius)
            return pa.table({"shard": [shard], "tree": [pickle.dumps(tree)]}, schema=pa.schema([("shard", pa.string()), ("tree", pa.binary())]))

        chosen = now.filter(F.pmod(F.xxhash64(F.lit("plant"), "fp"), F.lit(1 << 30)) / float(1 << 30) < share)
        planted = {r["shard"]: bytes(r["tree"]) for r in chosen.groupBy("shard").applyInArrow(plant, "shard string, tree binary").collect()}

        def deal(batches):
            import pickle

            trees = {k: pickle.loads(v) for k, v in planted.items()}
            for batch in batches:
                shards = np.array(batch.column(0).to_pylist(), dtype=object)
                points = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for name in set(shards.tolist()):
                    own = points[shards == name]
                    for path, part in _parts(own, name, trees.get(name), sizes[name], radius, shard_size):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(part)], names=["shard", "fp"])

        dealt = materialize(now.mapInArrow(deal, "shard string, fp long"), "shards")
        # names of oversized shards come back, one for each 2 * shard_size rows at most; block pairs are final
        over = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most) & ~F.col("shard").contains("|"))
        sizes = {r["shard"]: r["n"] for r in over.collect()}
        whole = dealt.filter(~F.col("shard").isin(list(sizes))) if sizes else dealt
        done = whole if done is None else done.unionByName(whole)
        now = dealt.filter(F.col("shard").isin(list(sizes)))
    return done


def _parts(points: np.ndarray, name: str, tree, size: int, radius: int, shard_size: int):
    """(shard, points) of one shard's points: by its tree, or by pairs of blocks."""
    if tree is not None:
        for path, at in route(points.view(np.uint64), tree, radius):
            if len(at):
                yield f"{name}/{path}", points[at]
        return
    blocks = -(-size // shard_size) + 1  # blocks vary in size; a pair of them stays in bounds
    mixed = (points.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    block = (mixed % np.uint64(blocks)).astype(np.int64)
    for b in np.unique(block):
        for other in set(range(blocks)) - {int(b)}:
            yield f"{name}|{min(b, other)}-{max(b, other)}", points[block == b]


def near_links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, sample: int = SAMPLE) -> DataFrame:
    """Spanning links ``(a, b)`` between the distinct fingerprints ``(fp)``.

    Only trees of vantage points reach the driver; every fingerprint is dealt to its
    shards and compared there.
    """

    def link(table: pa.Table) -> pa.Table:
        points = np.unique(table.column("fp").to_numpy().astype(np.int64))
        root = link_points(points.view(np.uint64), radius)
        at = np.nonzero(root != np.arange(len(points)))[0]
        return pa.table({"a": points[at], "b": points[root[at]]})

    return deal_shards(distinct, radius, shard_size, sample).groupBy("shard").applyInArrow(link, "a long, b long")


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """``(doc_id, k, fp, component_id, component_k)`` of every row."""
    marked = materialize(fingerprints(docs), "fingerprints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), "k")))
    nodes = materialize(marked.groupBy("fp").agg(first.alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    owners = with_least(nodes, "fp", components(near_links(nodes.select("fp"), radius)))
    return hot_join(marked, owners, ["fp"]).select(
        "doc_id", "k", "fp", F.col("least.id").alias("component_id"), F.col("least.k").alias("component_k")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs(doc_id, text)``.

    Texts that are null, empty or white space share fingerprint zero and are
    linked like any other.  component_id is the smallest non-null doc_id of the
    group (null where all are null); repeated rows stay; texts of any length are
    read whole; other columns play no part.  Equal fingerprints are one node, and
    its rows get their component in salted parts.
    """
    return _grouped(docs, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group, the smallest (doc_id, MD5 of the text), all columns.

    Rows without a doc_id cannot be named by a group and stay; repeated rows (same
    doc_id and text) become one; different texts under one doc_id are judged apart.
    """
    return keep_named(docs, _grouped(docs, radius))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; see ``near_duplicates``
    for nulls, empty and long texts, ties and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
