"""Near copies of the pipeline's stage against brute force."""

import random

import corpus_pipeline
from scriptorium.llm import near_copies


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_least(sets):
    """Smallest id of each document's component at similarity 0.8."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9)))
    rows = []
    for base in range(12):
        words = [word() for _ in range(200)]
        rows.append((100 * base, " ".join(words)))
        for k in range(1, 9):  # up to 8 words changed: similarities on both sides of 0.8
            edited = list(words)
            for at in rng.sample(range(200), k):
                edited[at] = word()
            rows.append((100 * base + k, " ".join(edited)))
    want = plain_least(plain_sets(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert 12 <= len(set(want.values())) < len(rows)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(want.values())


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain_least(plain_sets([tuple(r) for r in docs.collect()]))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want


def test_odd_rows(spark):
    rows = [(None, "same text here"), (7, "Same  text here"), (8, None), (9, " "), (10, "a b c d e f"), (None, "other"), (7, "Same  text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (8, 8), (9, 8), (10, 10), (None, None)], key=str)
    assert near_copies.keep_one(df).count() == 5
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_bitmap_never_misses(spark):
    from scriptorium.llm._util import maybe_in

    rows = spark.range(0, 40_000).selectExpr("id", "md5(cast(id as string)) as k", "id as at")
    told = maybe_in(rows, rows.filter("id % 10 = 0"), ["id", "k"], "hit")
    assert told.columns == ["id", "k", "at", "hit"]
    counts = told.selectExpr("id % 10 = 0 as wanted", "hit").groupBy("wanted", "hit").count().collect()
    found = {(r["wanted"], r["hit"]): r["count"] for r in counts}
    assert found[True, True] == 4000 and (True, False) not in found
    assert sum(found.values()) == 40_000 and found[False, True] < 36_000 / 8
    assert maybe_in(rows, rows.filter("false"), ["k"], "hit").filter("hit").count() == 0
