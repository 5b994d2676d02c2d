"""Packing, token files and byte-level BPE against the public libraries."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import _tokens, bpe, packing, token_files

RNG = random.Random(0)
ALPHABET = "abcXYZ  \n\n.,'s!é ñ ß12²½ª \t　中文\U0001F600<|>$#_-ʼ"
TEXTS = [None, "", " ", "a", "\n", " a", "a ", "a  b", "x\n\ny", "dogs' it's I'll <|endoftext|> x", "a<|endoftext|>", "<|endoftext|>", "two words <|endoftext|><|endoftext|>b\nc <|endoftext", "word " * 3000, "z" * 5000]
TEXTS += ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 60))) for _ in range(300)]


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def documents(spark, texts=TEXTS):
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, "a", 0), (None, "lost", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)


def test_unit_cache_equals_library():
    encoder = _tokens.public_encoder()
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(TEXTS)] == library_ids(TEXTS)
    for batched in (True, False):
        small = _tokens.UnitCache(encoder.encode_units, b"".join, limit=50, batched=batched, added=encoder.added)
        for lo in range(0, len(TEXTS), 7):
            part = TEXTS[lo : lo + 7]
            assert [np.frombuffer(b, "<u4").tolist() for b in small.encode(part)] == library_ids(part)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=40))
def test_pack_places_every_token_once(lengths):
    pieces = packing.pack(lengths)
    fill, seen = {}, {}
    for d, s, n, q, o in pieces:
        assert 0 < n <= 1024
        seen.setdefault(d, []).append((s, n))
        fill.setdefault(q, []).append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen.get(d, [])):
            assert s == at
            at += k
        assert at == n
    padding = 0
    for parts in fill.values():
        at = 0
        for o, k in sorted(parts):
            assert o == at
            at += k
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_pack_balances_cost():
    rng = random.Random(5)
    lengths = [rng.randint(1, 500) for _ in range(4000)]
    costs = {}
    for _, _, n, q, _ in packing.pack(lengths):
        costs[q] = costs.get(q, 0) + packing.cost(n)
    full = sorted(costs.values())[20:]  # but for the tail of powers of two
    in_order, room, naive = 0.0, 1024, []
    for n in lengths:
        if n > room:
            naive.append(in_order)
            in_order, room = 0.0, 1024
        in_order += packing.cost(n)
        room -= n
    assert np.std(full) / np.mean(full) < np.std(naive) / np.mean(naive)


def test_packed_documents(spark):
    docs = documents(spark)
    got = packing.pack_documents(docs, window_tokens=2000, with_ids=True).collect()
    by = {}
    for r in got:
        ids = np.array(r.ids, dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
        by.setdefault(r.doc_id, []).append((r.start, list(r.ids), r.doc_tokens))
    want = library_ids(TEXTS)
    for i, ids in enumerate(want):
        if i == 3:
            continue
        whole = [x for _, part, _ in sorted(by[i]) for x in part]
        assert whole == ids + [0] and {n for _, _, n in by[i]} == {len(whole)}
    assert len(by[3]) == 2 and len(by[None]) == 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark)
    manifest = token_files.write_token_files(docs, str(tmp_path / "t"), partitions=3)
    got = sorted(token_files.read_token_files(spark, manifest, with_ids=True).collect(), key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in got][:2] == [None, 0] and len(got) == len(TEXTS) + 2
    want, at = dict(enumerate(library_ids(TEXTS))) | {None: library_ids(["lost"])[0]}, 0
    for r in got:
        ids = want[r.doc_id] + [2]
        assert (list(r.ids), r.start, r.n_tokens, r.ids_crc32) == (ids, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.write_token_files(docs.limit(0), str(tmp_path / "none")) == []
    assert token_files.read_token_files(spark, []).count() == 0


def test_reader_opens_only_what_is_asked():
    rng = np.random.default_rng(0)
    docs = [(i // 2, rng.integers(0, 50000, rng.integers(0, 400)).astype("<u4").tobytes()) for i in range(500)]
    data = b"".join(token_files.write_frames(docs, frame_ids=2000))
    file = token_files.TokenFile(io.BytesIO(data))
    found = file.get(100)
    assert [f.tobytes() for f in found] == [b for d, b in docs if d == 100]
    assert file.frames_read <= 2 < len(file.directory)
    import zstandard

    # a plain decoder skips the tables and gets all frames
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert len(reader.read()) == sum(file.sizes)


def test_damage_is_noticed():
    data = bytearray(b"".join(token_files.write_frames([(1, b"\1\0\0\0" * 500), (2, b"\2\0\0\0" * 500)], frame_ids=1)))
    data[20] ^= 255
    file = token_files.TokenFile(io.BytesIO(bytes(data)))
    with pytest.raises(token_files.Corrupt):
        file.frame(0)
    assert file.frame(1)[0][0] == 2
    with pytest.raises(token_files.Corrupt):
        token_files.TokenFile(io.BytesIO(bytes(data[:-3])))


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark):
    enc = tiktoken_encoding()
    got = sorted(bpe.encode_documents(documents(spark), with_ids=True).filter("doc_id != 3").collect(), key=lambda r: r.doc_id)
    for r, (i, t) in zip(got, [(i, t) for i, t in enumerate(TEXTS) if i != 3]):
        ids = enc.encode_ordinary(t or "")
        assert (r.doc_id, list(r.ids), r.n_tokens) == (i, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(documents(spark).limit(0)).count() == 0


def test_trees_merge_leftmost_lowest():
    own, _ = bpe.rank_encoder()
    rng = random.Random(2)
    for n in [*range(1, 70), 200, 1000]:
        piece = bytes(rng.choice(b"abenrst ") for _ in range(n))
        symbols = [own.ranks[bytes([b])] for b in piece]
        while True:
            ranks = [own.pairs.get(a * own.width + b, 1 << 60) for a, b in zip(symbols, symbols[1:])]
            if not ranks or min(ranks) == 1 << 60:
                break
            k = ranks.index(min(ranks))
            symbols[k : k + 2] = [ranks[k]]
        assert own._merge_one(piece).tolist() == symbols if n > 1 else True
        if 1 < n <= 64:
            assert own._merge_rows([piece, piece[::-1], piece], max(4, 1 << (n - 1).bit_length()))[2].tolist() == symbols


def test_shared_folder_names_its_store(spark):
    from scriptorium.llm import _files, _util

    folder = _util.shared_dir(spark)
    assert folder.startswith("file:///")
    path = f"{folder}/sub/one.bin"
    assert _files.write_whole(path, [b"ab", b"c"]) == 3
    with _files.open_random(path) as f:
        assert f.read() == b"abc"
    spark.read.format("binaryFile").load(path).count()
    _util.remove(spark, f"{folder}/sub")


def test_files_survive_a_repeated_task(spark, tmp_path):
    docs = documents(spark)
    first = token_files.write_token_files(docs, str(tmp_path / "t"), partitions=3)
    bytes_ = {m["path"]: open(m["path"], "rb").read() for m in first}
    again = token_files.write_token_files(docs, str(tmp_path / "t"), partitions=3)
    assert again == first and {m["path"]: open(m["path"], "rb").read() for m in again} == bytes_


def test_cache_of_two_halves_gives_the_library_ids():
    """Units return from the old half; neither half outgrows its share by more than one text."""
    encoder = _tokens.public_encoder()
    made = _tokens.UnitCache(encoder.encode_units, b"".join, 20, batched=False)
    texts = [f"the same words again\nword{i} and {'x' * (i % 7)}y the same" for i in range(100)] * 2
    for text, ids in zip(texts, library_ids(texts)):
        assert np.frombuffer(made.encode([text])[0], "<u4").tolist() == ids
        assert max(len(made.spaced) + len(made.plain), len(made.old_spaced) + len(made.old_plain)) <= 20
    assert "same" in {**made.spaced, **made.old_spaced}


def test_small_token_files_share_a_reading_task(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', cast(id % 9 AS int)) AS text")
    manifest = token_files.write_token_files(docs, str(tmp_path / "t"), partitions=40)
    read = token_files.read_token_files(spark, manifest)
    by_task = [[r.doc_id for r in rows] for rows in read.rdd.glom().collect()]
    assert len(manifest) == 40 and len(by_task) <= 2 * spark.sparkContext.defaultParallelism and all(by_task)
    assert [d for rows in by_task for d in rows] == list(range(400))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=60), st.integers(1, 12), st.integers(1, 5000))
def test_reading_tasks_are_consecutive_and_bounded(sizes, least, most):
    tasks = token_files.reading_tasks(sizes, least, most)
    assert len(tasks) == len(sizes) and tasks[0] == 0
    assert all(b - a in (0, 1) for a, b in zip(tasks, tasks[1:]))
    n = max(least, -(-sum(sizes) // most))
    for task in set(tasks):
        held = [s for s, t in zip(sizes, tasks) if t == task]
        assert sum(held) - held[0] / 2 - held[-1] / 2 <= sum(sizes) / n
    assert tasks[-1] < n or n >= len(sizes)
    assert token_files.reading_tasks([1] * 4, 6) == [0, 1, 2, 3] and token_files.reading_tasks([1] * 9, 3) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert token_files.reading_tasks([3] * 8, 2, 6) == [0, 0, 1, 1, 2, 2, 3, 3]
