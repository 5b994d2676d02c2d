"""Near copies by five-word shingles: SimHash groups, completed by MinHash bands.

Two documents are linked where the Jaccard similarity of their shingle sets is at
least ``SIMILAR``; groups are the connected components.  Documents of one shingle
set are one node.

Buckets come from the SimHash operator, run on five-word shingles (a group of
fingerprints within 3 bits, found by its vantage-point trees, is a bucket), and,
because pairs at 0.8 lie some 10 bits apart, where no vantage-point tree prunes,
from MinHash bands.  A bucket's nodes are compared with its hub, the node that shares
most buckets with others (the original of edited copies, say), those not joined to
it with the hub among themselves.  What is then in different components is compared
where it has to be: a pair at 0.8 shares one of its rarest fifth of shingles (a
shingle in ``RARE`` nodes at most pairs few), or else has only frequent ones in
common, and then enough of these on both sides.  Pairs whose sizes, fingerprints or signatures are too far apart for 0.8 are
left out first; every link is checked on whole shingle sets, so nothing dissimilar is
linked.  Of pairs at 0.8 about 4 in 10 000 share no band, of more similar ones fewer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, with_least
from ._util import hot_join, keep_named, mapped, materialize, maybe_in, return_heap, text_key, worker_state
from .simhash import bits_of, lanes_of_bytes, near_links

SHINGLE_WORDS, SIMILAR, SEED = 5, 0.8, 42
#: Bands, and minimum hashes in a band.
BANDS, ROWS = 20, 5
#: Rounds of comparing with a bucket's hub before pairs are compared.
STARS = 2
#: Of 100 minimum hashes a pair at 0.8 shares 80, give or take 4; with fewer than this none is compared.
AGREE = 60
#: Nodes in which a shingle counts as rare.
RARE = 50
#: Fingerprints of a pair at 0.8 differ in 10 bits of 64, give or take 3; beyond this no pair is compared.
MOST_BITS = 24


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    first = [0, *(ends[: n - SHINGLE_WORDS] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(first, ends[SHINGLE_WORDS - 1 :].tolist())], np.uint64))


def least_hashes(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of each hash function; a text without words has the greatest number."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(least, (factors[0][:, None] * hashes[lo : lo + 2048] + factors[1][:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band."""
    import xxhash

    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def random_factors() -> np.ndarray:
    made = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
    made[0] |= np.uint64(1)
    return made


def _sketch_batches(batches):
    import xxhash

    worker_state("near_copies")
    factors, lanes = random_factors(), lanes_of_bytes()
    for batch in batches:
        nodes, keys, prints, sizes, sigs = [], [], [], [], []
        for t in batch.column(2):
            h = shingles(t.as_py())
            nodes.append(xxhash.xxh3_64_intdigest(h.tobytes(), SEED))
            least = least_hashes(h, factors)
            keys.append(band_keys(least))
            sigs.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
            prints.append(bits_of(h, lanes))
            sizes.append(len(h))
        found = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["doc_id", "k", "node", "bands", "fp", "size", "sig"])


def _similar_batches(batches):
    worker_state("near_copies")
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep, last, other = [], None, None
        for i in range(batch.num_rows):
            x = shingles(batch.column(2)[i].as_py())
            if b[i] != last:
                last, other = b[i], shingles(batch.column(3)[i].as_py())
            common = len(np.intersect1d(x, other, assume_unique=True))
            if common >= SIMILAR * (len(x) + len(other) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _possible(left: str, right: str):
    """Whether sizes and fingerprints of two nodes allow a similarity of ``SIMILAR``."""
    a, b = F.col(f"{left}.size"), F.col(f"{right}.size")
    near = F.bit_count(F.col(f"{left}.fp").bitwiseXOR(F.col(f"{right}.fp"))) <= MOST_BITS
    return (F.least(a, b) >= SIMILAR * F.greatest(a, b)) & near


def _agreeing_batches(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["node", "rep"]).filter(pa.array((a == b).sum(axis=1) >= AGREE))


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """``(band, x)`` of the buckets that hold two nodes or more; x is (weight, node, fp,
    size), a node's weight being the number of rows in its buckets."""
    groups = components(near_links(nodes.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    simhash = nodes.join(groups, "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("band"), "node")
    buckets = nodes.select(F.explode("bands").alias("band"), "node").unionByName(simhash)
    counts = materialize(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("m", F.col("n")), "counts")
    shared = materialize(hot_join(buckets, counts, ["band"], "inner"), "shared")
    known = shared.groupBy("node").agg(F.sum("m").alias("weight")).join(nodes.select("node", "fp", "size"), "node")
    return materialize(shared.join(known, "node").select("band", F.struct("weight", "node", "fp", "size").alias("x")), "buckets")


def _shingle_batches(batches):
    for batch in batches:
        found = pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["node", "of"])


def _apart_pairs(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``(x, rep)`` of different components among which are all those of
    ``open_(band, x, root)`` that share a band and reach ``SIMILAR``.

    Two sets of that similarity share a shingle among the rarest ``size - 0.8 * size +
    1`` of each.  If one of these is rare, the join on rare shingles finds the pair.  If
    not, both reach into their frequent shingles there, all their rare ones lie before,
    and none of those is shared: so the frequent ones alone must suffice.
    """
    each = materialize(mapped(texts.select("node", "text"), _shingle_batches, "node long, of array<long>"), "shingles")
    flat = each.select("node", F.explode("of").alias("s"))
    spread = materialize(flat.groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("df", F.col("n")), "spread")
    ranked = hot_join(flat, spread, ["s"], "inner").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("of"))
    prefix = F.size("of") - F.ceil(F.lit(SIMILAR) * F.size("of")).cast("int") + 1
    ranked = materialize(
        ranked.select("node", F.size(F.filter("of", lambda t: t["df"] > RARE)).alias("frequent"), F.filter(F.slice("of", F.lit(1), prefix), lambda t: (t["df"] > 1) & (t["df"] <= RARE)).alias("rare")),
        "ranked",
    )
    rows = open_.select("x", "root", F.col("x.node").alias("node")).distinct().join(ranked, "node")
    rare = materialize(rows.select(F.explode("rare.s").alias("s"), "x", "root"), "rare")
    left, right = rare.alias("l"), rare.select("s", F.col("x").alias("rep"), F.col("root").alias("other")).alias("r")
    apart = (F.col("root") != F.col("other")) & (F.col("x.node") > F.col("rep.node")) & _possible("x", "rep")
    by_rare = left.join(right, (F.col("l.s") == F.col("r.s")) & apart).select("x", "rep").distinct()
    # frequent ones can suffice only where they are most of a set
    most = rows.filter(F.col("frequent") >= SIMILAR * F.col("x.size")).select("node", "frequent")
    some = materialize(open_.withColumn("node", F.col("x.node")).join(most, "node").drop("node"), "frequent")
    left, right = some.alias("l"), some.select("band", F.col("x").alias("rep"), F.col("root").alias("other"), F.col("frequent").alias("frequent_2")).alias("r")
    enough = F.least("frequent", "frequent_2") * (1 + SIMILAR) >= SIMILAR * (F.col("x.size") + F.col("rep.size")) - 1e-6
    by_frequent = left.join(right, (F.col("l.band") == F.col("r.band")) & enough & apart).select("x", "rep")
    return by_rare.unionByName(by_frequent)


def similar_groups(docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """``(node, root)`` of the components of ``nodes(node, k, bands, fp, size, sig)``, whose
    texts are those of ``docs`` with digest k; None where no bucket holds two."""
    nodes = nodes.filter("size > 0")
    shared = _shared_buckets(nodes)
    sigs = nodes.select("node", "sig")
    links, tried = None, None

    def text_of_nodes(some: DataFrame) -> DataFrame:
        wanted = materialize(nodes.select("node", "k").join(some, "node"), "ends")
        keyed = maybe_in(docs.select(text_key(F.col("text")).alias("k"), "text"), wanted, ["k"], "hit").filter("hit").join(wanted, "k")
        return materialize(keyed.groupBy("node").agg(F.min("text").alias("text")), "texts")

    def compare(tied: DataFrame) -> DataFrame:
        """All links so far, with those among the pairs (x, rep) of ``tied`` not tried before."""
        nonlocal links, tried
        pairs = tied.select("x.node", F.col("rep.node").alias("rep")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["node", "rep"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        signed = pairs.join(sigs, "node").join(sigs.select(F.col("node").alias("rep"), F.col("sig").alias("other")), "rep")
        close = materialize(mapped(signed.select("node", "rep", "sig", "other"), _agreeing_batches, "node long, rep long"), "close")
        texts = text_of_nodes(close.select("node").union(close.select("rep")).distinct())
        both = close.join(texts.withColumnRenamed("text", "x"), "node").join(texts.select(F.col("node").alias("rep"), F.col("text").alias("y")), "rep")
        found = materialize(mapped(both.select(F.col("node").alias("a"), F.col("rep").alias("b"), "x", "y"), _similar_batches, "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
        return_heap(docs.sparkSession)  # texts were shuffled and sorted
        return links

    def open_buckets() -> DataFrame:
        """``(band, x, root)`` of the buckets that still hold several components."""
        placed = shared.withColumn("root", F.col("x.node"))
        if roots is not None:
            known = roots.select(F.col("node").alias("own"), F.col("root").alias("of"))
            placed = shared.join(known, F.col("x.node") == F.col("own"), "left").select("band", "x", F.coalesce("of", "x.node").alias("root"))
            placed = materialize(placed, "placed")
        mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
        return materialize(hot_join(placed, materialize(mixed.select("band", "n"), "mixed"), ["band"], "inner"), "open")

    roots = hubs = None  # components so far; (band, root) of the hubs of the round before
    for _ in range(STARS):
        open_ = open_buckets()
        if open_.isEmpty():
            return roots
        outside = open_ if hubs is None else open_.join(hubs, ["band", "root"], "left_anti")
        hub = outside.groupBy("band").agg(F.max(F.struct("x", "root")).alias("hub"), F.count(F.lit(1)).alias("n"))
        hub = materialize(hub, "hubs")
        tied = hot_join(open_, hub, ["band"], "inner").select("x", "root", F.col("hub.x").alias("rep"), F.col("hub.root").alias("other"))
        roots = components(compare(tied.filter((F.col("root") != F.col("other")) & _possible("x", "rep"))))
        known = roots.select(F.col("node").alias("own"), F.col("root").alias("of"))
        hubs = hub.join(known, F.col("hub.x.node") == F.col("own"), "left").select("band", F.coalesce("of", "hub.x.node").alias("root"))
    open_ = open_buckets()
    if open_.isEmpty():
        return roots
    return components(compare(_apart_pairs(open_, text_of_nodes(open_.select("x.node").distinct()))))


def grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, k, component_id, component_k)``, one row per row of ``docs(doc_id, text)``:
    the MD5 of the text, and the smallest (doc_id, MD5) of the group."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k"), "text")
    marked = materialize(mapped(named, _sketch_batches, "doc_id long, k string, node long, bands array<long>, fp long, size long, sig binary"), "sketches")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), "k")))
    nodes = materialize(
        marked.groupBy("node").agg(
            first.alias("least"), F.min("k").alias("k"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("bands", "fp", "size", "sig")]
        ),
        "nodes",
    )
    roots = similar_groups(docs, nodes)
    owners = nodes.select("node", "least", "n")
    if roots is not None:
        owners = with_least(owners, "node", roots)
    return hot_join(marked.select("doc_id", "k", "node"), owners, ["node"]).select(
        "doc_id", "k", F.col("least.id").alias("component_id"), F.col("least.k").alias("component_k")
    )


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)``, one row per row of ``docs(doc_id, text)``.

    component_id is the smallest non-null doc_id of the group (null where all are
    null).  Null and empty texts, and texts of white space, have no shingles and are
    one group; a text of fewer than five words is one shingle.  Texts of any length
    are compared whole; repeated rows keep their rows; other columns play no part.
    """
    return grouped(docs).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the smallest (doc_id, MD5 of the text), all columns.

    Rows without a doc_id cannot be named by a group and stay; repeated rows (same
    doc_id and text) become one, whichever of them; different texts under one doc_id
    are judged apart.
    """
    return keep_named(docs, grouped(docs))
