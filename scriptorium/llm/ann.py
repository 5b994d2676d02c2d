"""Nearest neighbours by inner product with a hash-prefix forest.

Each tree of the forest hashes a vector to a long bit string (signs of random
projections) and keeps the strings sorted.  A query descends in every tree to its
longest matching prefix; then all trees ascend together, one bit at a time,
widening their ranges until these hold enough entries.  A vector has a vote from
each tree in whose range it lies; those of most votes are the candidates, and are
scored exactly, in double precision.

Vectors are dealt to blocks, each with a forest of its own; the query set goes to
every block, and each block returns its nearest.  No bucket is capped: a range
that holds many vectors is taken whole, and so are all that tie in votes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import materialize, tasks_for

#: Trees, and bits of a hash string.
TREES, BITS = 300, 24
#: Entries that the ranges of all trees hold together, for each vector of the block.
REACH = 8.0
#: Share of a block taken as candidates, and how many candidates there are at least
#: for each neighbour wanted (a block with no more is its own candidate set).
SHARE, LEAST = 0.06, 30
#: Distinct vectors in a block, query vectors in a group.
BLOCK, GROUP = 25_000, 20_000
TOP = 20


class Forest:
    """Sorted hash strings of one block of unit-scaled vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((vectors.shape[1], trees * bits)).astype(np.float32)
        strings = self.hashes(vectors)
        # one contiguous row a tree
        self.order = np.argsort(strings.T, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(np.ascontiguousarray(strings.T), self.order.astype(np.int64), axis=1)

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, trees) bit strings as integers, first bit highest."""
        out = np.empty((len(vectors), self.trees), dtype=np.uint32)
        for lo in range(0, len(vectors), 2048):
            signs = (vectors[lo : lo + 2048].astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, self.bits)
            octets = np.packbits(signs, axis=2)  # padded with zeros behind
            whole = np.zeros((*octets.shape[:2], 4), np.uint8)
            whole[:, :, : octets.shape[2]] = octets
            out[lo : lo + 2048] = whole.view(">u4")[:, :, 0] >> np.uint32(32 - self.bits)
        return out

    def ranges(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, (queries, trees) each, after the synchronous ascent: the deepest
        level at which the trees' ranges hold ``wanted`` entries together."""
        strings = self.hashes(queries)
        lo = np.zeros(strings.shape, np.int64)
        hi = np.full(strings.shape, len(self.vectors), np.int64)
        todo = np.arange(len(queries))
        for level in range(self.bits, -1, -1):
            if not len(todo):
                break
            shift = np.uint64(self.bits - level)
            low = (strings[todo].astype(np.uint64) >> shift) << shift
            high = low + ((np.uint64(1) << shift) - np.uint64(1))
            low, high = low.astype(np.uint32), high.astype(np.uint32)
            a, b = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
            for t in range(self.trees):
                a[:, t] = np.searchsorted(self.sorted[t], low[:, t], "left")
                b[:, t] = np.searchsorted(self.sorted[t], high[:, t], "right")
            enough = ((b - a).sum(axis=1) >= wanted) | (level == 0)
            lo[todo[enough]], hi[todo[enough]] = a[enough], b[enough]
            todo = todo[~enough]
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, wanted: int) -> np.ndarray:
        """Positions of the ``wanted`` vectors with most votes in one query's ranges, and
        of all that tie with the last of them; ascending."""
        held = np.concatenate([row[a:b] for row, a, b in zip(self.order, lo.tolist(), hi.tolist())])
        votes = np.bincount(held, minlength=len(self.vectors))
        least = np.partition(votes, len(votes) - wanted)[len(votes) - wanted] if wanted < len(votes) else 0
        return np.nonzero(votes >= max(1, least))[0]


def search(
    vectors: np.ndarray, queries: np.ndarray, keep: int, share: float = SHARE, trees: int = TREES, bits: int = BITS, reach: float = REACH, least: int = LEAST
):
    """For each query, positions and scores of its ``keep`` best in ``vectors``.

    Norms vary in inner-product search; one more coordinate makes all norms equal
    and turns the largest product into the smallest angle.  Of equal scores at the
    end of a list all are kept, so later ties can be broken by id.
    """
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1)
    top = norms.max()
    lifted = np.concatenate([vectors, np.sqrt(np.maximum(0, top * top - norms * norms))[:, None]], axis=1) / top
    forest = Forest(lifted, trees, bits)
    raised = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    wanted = min(n, max(int(np.ceil(share * n)), least * keep) + 1)
    # at the root every tree holds all; below, a vector has ``reach`` votes on average
    entries = n * trees if wanted == n else int(n * min(trees, max(reach, -2 * np.log1p(-wanted / n)))) + trees
    for at in range(0, len(queries), 1024):
        lo, hi = forest.ranges(raised[at : at + 1024], entries)
        for k in range(len(lo)):
            found = forest.candidates(lo[k], hi[k], wanted)
            scores = vectors[found] @ queries[at + k]
            if len(found) > keep:
                edge = np.partition(scores, len(found) - keep)[len(found) - keep]
                some = scores >= edge - 1e-9 * max(1.0, abs(edge))
                found, scores = found[some], scores[some]
            yield at + k, found, scores


def exact_score(a: np.ndarray, b: np.ndarray) -> float:
    """Inner product in double precision, correctly rounded from exact products."""
    import math

    return math.fsum((a.astype(np.float64) * b.astype(np.float64)).tolist())


def distinct_vectors(embeddings: DataFrame, members: int = TOP + 1) -> DataFrame:
    """``(vec, key, ids)``: each distinct usable vector with its smallest ids.

    Copies of a vector tie everywhere, so of a group only the ``members`` smallest
    ids can appear in any answer; the group limit is applied before the shuffle.
    Vectors that are null, empty, zero or hold nulls or non-finite components take
    no part.
    """
    v = F.col("embedding").cast("array<double>")
    usable = (
        F.col("embedding").isNotNull()
        & F.col("vec_id").isNotNull()
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    )
    rows = embeddings.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"), F.to_json(F.struct(v)).alias("key"))
    rows = rows.withColumn("key", F.sha2(F.col("key"), 256)).groupBy("key", "vec_id").agg(F.first("vec").alias("vec"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= members).groupBy("key").agg(
        F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")
    )


def nearest(
    embeddings: DataFrame, is_query: F.Column, top: int = TOP, block: int = BLOCK, group: int = GROUP, share: float = SHARE
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's ``top`` nearest others.

    ``is_query`` is a condition on vec_id.  Nearest first, ties to the smaller
    vec_id; all candidates where there are fewer.  Rows of one vec_id and one
    vector count once; vectors of another length than the query's are no
    candidates of it.  Vectors that are null, empty, zero or hold nulls or non-finite
    components take no part; a query among them has no rows.
    """
    keep = top + 1  # the query itself may be among them
    base = materialize(distinct_vectors(embeddings, keep), "vectors", tasks_for(embeddings))
    base = base.withColumn("dim", F.size("vec"))
    # blocks and groups are counted for each length of vectors
    large = [(r["dim"], r["n"]) for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min(block, group)).collect()]

    def parts(dim: str, size: int):
        out = F.lit(1).cast("long")
        for d, n in large:
            out = F.when(F.col(dim) == d, F.lit(-(-n // size)).cast("long")).otherwise(out)
        return out

    queries = (
        embeddings.filter(is_query)
        .select(F.col("vec_id").cast("long").alias("query_id"), F.sha2(F.to_json(F.struct(F.col("embedding").cast("array<double>"))), 256).alias("key"))
        .distinct()
    )
    points = base.select(*[F.col(c).alias(f"q_{c}") for c in ("key", "vec", "dim")])
    wanted = queries.select(F.col("key").alias("q_key")).distinct().join(points, "q_key")
    spread = lambda key, m: F.pmod(F.xxhash64(F.lit("deal"), key), m)
    every = lambda m: F.sequence(F.lit(0).cast("long"), m - 1)
    left = base.withColumns({"b": spread("key", parts("dim", block)), "g": F.explode(every(parts("dim", group)))})
    right = wanted.withColumns({"q_g": spread("q_key", parts("q_dim", group)), "q_b": F.explode(every(parts("q_dim", block)))})
    schema = pa.schema([("qkey", pa.string()), ("key", pa.string()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in schema.names}
        if have.num_rows and ask.num_rows:
            dim = have.column("dim")[0].as_py()
            grid = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            vectors, points = grid(have.column("vec")), grid(ask.column("q_vec"))
            keys, ids, asked = have.column("key").to_pylist(), have.column("ids"), ask.column("q_key").to_pylist()
            for q, found, scores in search(vectors, points, keep, share):
                scores = np.array([exact_score(vectors[f], points[q]) for f in found])
                order = np.argsort(-scores, kind="stable")
                edge = scores[order[min(keep, len(order)) - 1]]
                for k in order:
                    if scores[k] < edge:
                        break
                    out["qkey"].append(asked[q])
                    out["key"].append(keys[found[k]])
                    out["score"].append(float(scores[k]))
                    out["ids"].append(ids[int(found[k])].as_py())
        return pa.table(out, schema)

    pairs = left.groupBy("dim", "b", "g").cogroup(right.groupBy("q_dim", "q_b", "q_g")).applyInArrow(
        run, "qkey string, key string, score double, ids array<long>"
    )
    # each distinct vector stands for its smallest ids: enough of them for any answer
    near = pairs.select("qkey", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= keep)
    lists = best.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("near"))
    own = queries.withColumnRenamed("key", "qkey").join(lists, "qkey")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    answers = own.select("query_id", F.posexplode(others).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
    # every block answers every query, so the lists that meet here grow with the blocks
    return answers.coalesce(tasks_for(embeddings, 1 + sum(n // block for _, n in large)))


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th row of ``embeddings``; see ``nearest`` for nulls,
    odd vectors, ties, repeated rows and small tables."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 20 == 0)
