"""Cost-balanced packing of tokenized documents into training sequences.

Documents are cut into pieces of at most ``capacity`` tokens.  A piece of n
tokens costs ``LINEAR * n + QUADRATIC * n * n`` (attention within the piece).
Pieces, most expensive first, go to the sequence of lowest cost that still has
room; where none has room for all of a piece, it is cut to fill the one with the
most room.  Packing runs inside each partition over windows of bounded size, so
nothing is shuffled and no task holds more than a window.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import VOCABULARY, public_encoder, slices
from ._util import mapped

CAPACITY = 1024
#: Relative cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that one window packs together.
WINDOW_TOKENS = 4_000_000
END_ID = 0


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths; (document, start, length, sequence, offset).

    Whole pieces of ``capacity`` get a sequence each.  The rest fills the fewest
    sequences that can hold it; the tokens that would leave the last of them part
    empty go to sequences of descending powers of two, which need no padding.
    """
    out, sequence, rest = [], 0, []
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((d, full * capacity, n % capacity))
    total = sum(r[2] for r in rest)
    rooms = [capacity] * (total // capacity)
    left = total % capacity
    rooms += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    used = [0] * len(rooms)
    # sequences by cost; those too full for the present piece wait under their room
    open_ = [(0.0, i) for i in range(len(rooms))]
    waiting: dict[int, list] = {}
    rooms_waiting: list[int] = []  # max-heap of the rooms that wait
    queue = [(-n, d, s) for d, s, n in rest]
    heapq.heapify(queue)
    while queue:
        n, d, s = heapq.heappop(queue)
        n = -n
        while rooms_waiting and -rooms_waiting[0] >= n:  # pieces got small enough
            room = -heapq.heappop(rooms_waiting)
            for entry in waiting.pop(room):
                heapq.heappush(open_, entry)
        chosen = None
        while open_:
            c, i = heapq.heappop(open_)
            room = rooms[i] - used[i]
            if room >= n:
                chosen = (c, i)
                break
            if room not in waiting:
                waiting[room] = []
                heapq.heappush(rooms_waiting, -room)
            waiting[room].append((c, i))
        if chosen is None:  # nobody can take it whole: fill the roomiest, of those the cheapest
            room = -rooms_waiting[0]
            some = waiting[room]
            at = min(range(len(some)), key=some.__getitem__)
            chosen = some[at]
            some[at] = some[-1]
            some.pop()
            if not some:
                del waiting[room]
                heapq.heappop(rooms_waiting)
            heapq.heappush(queue, (room - n, d, s + room))
            n = room
        c, i = chosen
        out.append((d, s, n, sequence + i, used[i]))
        used[i] += n
        if used[i] < rooms[i]:
            heapq.heappush(open_, (c + cost(n), i))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    window_tokens: int = WINDOW_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)``; each id lies in exactly one.

    A null text is empty and still has its end id.  Repeated rows are packed as
    separate documents; a null doc_id stays null.  A text of any length is encoded
    whole and cut into as many pieces as it takes; other columns play no part; pieces
    of one cost are placed in order of doc_id.  With ``with_ids`` the ids of a piece
    follow as an array.  sequence_id is the partition's number, then the
    number of the sequence in it.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        encoder = public_encoder(vocabulary)
        ids, tokens, size = [], [], 0

        def emit():
            nonlocal base
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, tokens[k]))
            pieces = pack([len(tokens[k]) // 4 for k in order], capacity)
            cols: list[list] = [[] for _ in range(7 + with_ids)]
            for d, s, n, q, o in pieces:
                own = tokens[order[d]]
                part = own[4 * s : 4 * (s + n)]
                for col, v in zip(cols, (ids[order[d]], s, n, zlib.crc32(part), len(own) // 4, base + q, o)):
                    col.append(v)
                if with_ids:
                    cols[7].append(np.frombuffer(part, "<u4").astype(np.int32))
            base += max((p[3] for p in pieces), default=-1) + 1
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
            table = pa.table(arrays, names=[*"doc_id start length ids_crc32 doc_tokens sequence_id offset".split(), *["ids"] * with_ids])
            return table.to_batches(max_chunksize=20_000)

        for some, texts in slices(batches):
            for i, t in zip(some, encoder.encode(texts)):
                ids.append(i)
                tokens.append(t + end)
                size += len(t) // 4 + 1
            if size >= window_tokens:
                yield from emit()
                ids, tokens, size = [], [], 0
        if ids:
            yield from emit()

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of every row of ``documents``; see ``pack_documents`` for nulls, empty
    and long texts, ties and repeated rows."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
