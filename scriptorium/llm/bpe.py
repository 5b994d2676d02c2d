"""Byte-level BPE encoding and decoding by ranks, with segment trees.

A segment tree over the byte positions of a piece stores, for each position that
starts a live symbol, the rank of the pair it forms with the next live symbol;
the root is the leftmost pair of minimum rank.  A merge updates the leaves of the
merged symbol, the one it swallowed and its left neighbour, each in logarithmic
time, so a piece of n bytes takes n log n.  Many short pieces are merged at once,
one tree to a row of an array; long pieces have a tree each.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import UnitCache, slices, vocabulary_path
from ._util import mapped, worker_state

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Longest piece, in bytes, that is merged together with others.
BATCHED_BYTES = 64
INF = np.int64(1) << 60


class RankBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.token_bytes[r] = b
        self.token_text = [str(i) for i in range(len(self.token_bytes))]
        self.width = len(self.token_bytes)
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for b, r in ranks.items():
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = r
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> RankBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; INF where a pair doesn't merge."""
        if not len(self.pair_keys):
            return np.full(len(left), INF)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], INF)

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Merge pieces of 2 to ``size`` bytes; ``size`` is a power of two."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        wide = size + 2  # one more position on either side stands for "none"
        symbols = np.full((n, wide), -1, np.int64)
        symbols[:, 1 : size + 1] = self.byte_rank[raw]
        symbols[:, 1:][np.arange(size + 1) >= lengths[:, None]] = -1
        after = np.tile(np.minimum(np.arange(1, wide + 1), size + 1), (n, 1))
        before = np.tile(np.maximum(np.arange(-1, wide - 1), 0), (n, 1))
        tree = np.full((n, 2 * size), INF)
        left, right = symbols[:, 1 : size + 1], symbols[:, 2 : size + 2]
        r, c = np.nonzero((left >= 0) & (right >= 0))
        rank = self._rank(left[r, c], right[r, c])
        live = rank < INF
        tree[r[live], size + c[live]] = rank[live] * size + c[live]
        level = size
        while level > 1:  # build
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        flat_tree, flat_symbols = tree.reshape(-1), symbols.reshape(-1)
        flat_after, flat_before = after.reshape(-1), before.reshape(-1)

        def leaf(row, at, value):
            """Set leaves; positions outside the piece are skipped."""
            ok = (at >= 1) & (at <= size)
            flat_tree[row[ok] * 2 * size + size + at[ok] - 1] = value[ok]

        rows = np.arange(n)
        while len(rows):
            top = flat_tree[rows * 2 * size + 1]
            alive = top < INF
            rows, top = rows[alive], top[alive]
            if not len(rows):
                break
            rank, at = top // size, top % size + 1
            base = rows * wide
            gone = flat_after[base + at]
            nxt = flat_after[base + gone]
            prv = flat_before[base + at]
            flat_symbols[base + at] = rank
            flat_symbols[base + gone] = -1
            flat_after[base + at] = nxt
            flat_before[base + nxt] = at
            right, left = flat_symbols[base + nxt], flat_symbols[base + prv]
            with_right = np.where(right >= 0, self._rank(rank, right), INF)
            with_left = np.where(left >= 0, self._rank(left, rank), INF)
            leaf(rows, at, np.where(with_right < INF, with_right * size + at - 1, INF))
            leaf(rows, gone, np.full(len(rows), INF))
            leaf(rows, prv, np.where(with_left < INF, with_left * size + prv - 1, INF))
            offset = rows * 2 * size
            nodes = [size + np.clip(x, 1, size) - 1 for x in (at, gone, prv)]
            for _ in range(size.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    k = offset + 2 * x
                    flat_tree[offset + x] = np.minimum(flat_tree[k], flat_tree[k + 1])
        return [row[row >= 0] for row in symbols]

    def _merge_one(self, piece: bytes) -> np.ndarray:
        """Merge one long piece with a tree of its own."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        symbols = self.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        inf, pairs, width = int(INF), self.pairs, self.width
        first = self._rank(np.array(symbols[:-1]), np.array(symbols[1:]))
        keys = np.where(first < INF, first * size + np.arange(n - 1), INF).tolist()
        tree = [inf] * (2 * size)
        tree[size : size + n - 1] = keys
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at: int, value: int):
            k = size + at
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b

        while tree[1] < inf:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            nxt, prv = after[gone], before[at]
            symbols[at], symbols[gone] = rank, -1
            after[at] = nxt
            put(gone, inf)
            if nxt < n:
                before[nxt] = at
                r = pairs.get(rank * width + symbols[nxt])
                put(at, inf if r is None else r * size + at)
            else:
                put(at, inf)
            if prv >= 0:
                r = pairs.get(symbols[prv] * width + rank)
                put(prv, inf if r is None else r * size + prv)
        return np.array([s for s in symbols if s >= 0], dtype=np.int64)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian u32.  A piece that is a token itself
        is that token, as the public library has it."""
        out: list[bytes | None] = [None] * len(pieces)
        sized: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif not p:
                out[k] = b""
            elif len(p) > BATCHED_BYTES:
                out[k] = self._merge_one(p).astype("<u4").tobytes()
            else:
                sized.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(k)
        for size, at in sized.items():
            for k, ids in zip(at, self._merge_rows([pieces[k] for k in at], size)):
                out[k] = ids.astype("<u4").tobytes()
        return out

    def encode_units(self, units: list[str], prefix: str = "", limit: int = 400_000) -> list[bytes]:
        """Ids of each text behind ``prefix``, each match of the pattern separately."""
        split = [self.pattern.findall(prefix + u) for u in units]
        new = {p for s in split for p in s}.difference(self.cache)
        if len(self.cache) + len(new) > limit:
            self.cache.clear()
            new = {p for s in split for p in s}
        new = list(new)
        for lo in range(0, len(new), 8192):
            some = new[lo : lo + 8192]
            self.cache.update(zip(some, self.merge([p.encode("utf-8", "surrogatepass") for p in some])))
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids) -> bytes:
        """Bytes of a sequence of ids."""
        return b"".join(map(self.token_bytes.__getitem__, ids))


def rank_encoder(vocabulary: str = VOCABULARY, pattern: str | None = None) -> tuple[RankBPE, UnitCache]:
    """The worker's encoder for a rank file."""
    state = worker_state("bpe")
    path = vocabulary_path(vocabulary)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if ("ranks", path, pattern) not in state:
        bpe = RankBPE.from_file(path, pattern)
        state["ranks", path, pattern] = bpe, UnitCache(bpe.encode_units, b"".join)
    return state["ranks", path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Encode and decode every row of ``docs(doc_id, text)``.

    Gives doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the bytes decoded from the ids), and the ids on demand.  A
    null text is empty: no ids, and both digests are those of nothing.  Texts of any
    length are encoded whole; repeated rows keep their rows; other columns play no part.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        bpe, cache = rank_encoder(vocabulary)
        text_of = bpe.token_text.__getitem__
        for ids, texts in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for d, b in zip(ids, cache.encode(texts)):
                own = np.frombuffer(b, "<u4")
                listed = own.tolist()
                rows[0].append(d)
                rows[1].append(len(listed))
                rows[2].append(hashlib.sha256(",".join(map(text_of, listed)).encode()).hexdigest())
                rows[3].append(hashlib.sha256(bpe.decode(listed)).hexdigest())
                if with_ids:
                    rows[4].append(own.astype(np.int32))
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(rows[4], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(texts, run, schema + (", ids array<int>" if with_ids else ""))


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` encoded and decoded; see ``encode_documents`` for
    nulls, empty and long texts and repeated rows."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
