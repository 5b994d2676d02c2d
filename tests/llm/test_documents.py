"""Language ID, SimHash groups and the pipeline."""

import random
import re
import zlib

import numpy as np
import xxhash

import corpus_pipeline
from scriptorium.llm import language_id, near_copies, packing, quality, simhash

from test_near_copies import plain_least, plain_sets

DATA = "/root/testdata/sf0.001"


def test_codewords():
    for k in (1, 2, 3, 4, 5, 6, 12):
        code = language_id.codewords(k)
        assert len({tuple(r) for r in code}) == k
        if k > 5:
            d = (code.shape[1] - code.astype(int) @ code.T) // 2
            assert d[~np.eye(k, dtype=bool)].min() >= code.shape[1] // 4


def test_language_id_learns_only_from_its_share(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.op2_language_id(spark, DATA).collect()
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    from pyspark.sql import functions as F

    # wrong labels in the held-out part change nothing
    swapped = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.identify(swapped, language_id.train(swapped)).collect()
    assert {r.doc_id: r.lang_pred for r in again} == {r.doc_id: r.lang_pred for r in got}


def test_language_id_edges(spark):
    model = language_id.fit(["the cat and the dog " * 3, "der hund und die katze " * 3] * 4, ["en", "de"] * 4)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (5, "die katze " * 60000), (None, "und der hund"), (4, "the dog")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = language_id.identify(df, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == list(zip([r[0] for r in rows], ["und"] * 3 + ["en", "de", "de", "en"]))
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.keep_identified(df, model).count() == 4
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    even = language_id.fit(["abc", "abc"] * 4, ["x", "y"] * 4)
    assert even.predict(["abc abc"])[0][2]  # two equal languages: ambiguous


def plain_decode(model, text):
    """Language, score and flag of one text, straight from the definition."""
    import math

    raw = [0x20, *text.lower().encode(), 0x20]
    margins = []
    for j in range(model.code.shape[1]):
        total = 0.0
        for i in range(len(raw) - 1):
            pair = raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77
            total += float(model.weights[pair % 2**32 >> 17, j])
            if i + 2 < len(raw):
                total += float(model.weights[language_id.BUCKETS + ((pair + raw[i + 2] * 0xC2B2AE3D) % 2**32 >> 17), j])
        margins.append(total / len(raw))
    loss = [sum(w * math.log1p(math.exp(-c * m * 4)) for w, c, m in zip(ws, cs, margins)) * 4 for ws, cs in zip(model.bit_weights.tolist(), model.code.tolist())]
    shares = [math.exp(min(loss) - x) for x in loss]
    shares = [x / sum(shares) for x in shares]
    first, second = sorted(shares, reverse=True)[:2]
    return model.languages[shares.index(first)], first, first - second < language_id.AMBIGUOUS


def test_decoding_equals_the_definition(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs)
    texts = [r.text for r in docs.limit(60).collect()] + ["a", "\u00c9t\u00e9 \U0001f600", "1a", "x" * 300]
    monkeypatch.setattr(language_id, "STEP", 37)  # windows must not change a result
    for t, (lang, score, flag) in zip(texts, model.predict(texts)):
        want = plain_decode(model, t)
        assert (lang, flag) == (want[0], want[2]) and abs(score - want[1]) < 1e-6
    assert [b for b in language_id.runs([10, 10, 20, 50, 1, 1])] == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_training_counts_equal_plain_counts(spark):
    rows = [(i, t, "de" if i % 3 else "en") for i, t in enumerate(["Abc abd", "xyz\u00e4", "", "abc"] * 30)]
    docs = spark.createDataFrame(rows + [(None, "abc", "en"), (200, None, "en"), (201, "abc", None)], "doc_id long, text string, lang string").repartition(3)
    sample = [tuple(r) for r in language_id.labelled_sample(docs.filter(~language_id.held_out(docs.doc_id))).collect()]
    assert sorted(t[:2] for t in sample) == sorted((x, t) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5)
    model = language_id.train(docs)
    counts = {}
    for lang in ("de", "en"):
        own = counts[lang] = np.zeros(2 * language_id.BUCKETS)
        for x, t, checks in sample:
            raw = [0x20, *t.lower().encode(), 0x20]
            for i in range(len(raw) - 1) if x == lang and not checks else ():
                pair = raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77
                own[pair % 2**32 >> 17] += 1
                if i + 2 < len(raw):
                    own[language_id.BUCKETS + ((pair + raw[i + 2] * 0xC2B2AE3D) % 2**32 >> 17)] += 1
    b = language_id.BUCKETS
    share = {k: np.concatenate([(c[:b] + 0.5) / (c[:b] + 0.5).sum(), (c[b:] + 0.5) / (c[b:] + 0.5).sum()]) for k, c in counts.items()}
    assert model.languages == ["de", "en"] and model.code.tolist() == [[1], [-1]]
    assert np.allclose(model.weights[:-1, 0], np.log(share["de"] / share["en"]), atol=1e-5)


def plain_fingerprint(text):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not w:
        return 0
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_groups(ids, prints, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    p = np.array(prints, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(p[i:] ^ p[i]) <= radius)[0] + i:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g}


def test_simhash_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "one"), (10_004, "ONE"), (10_005, "a b"), (10_006, "x y z " * 40000), (10_003, "one")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_groups([i for i, _ in rows], prints)
    assert len(got) == len(rows)
    assert {r.doc_id: r.fp % 2**64 for r in got} == {i: p for (i, _), p in zip(rows, prints)}
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v for v in want.values()})


def test_links_survive_every_cut(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = [x ^ np.uint64(sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), replace=False))) for x in base[:1500]]
    dense = [base[0] ^ np.uint64(1 << a | 1 << b) for a in range(40) for b in range(a)]
    points = np.unique(np.concatenate([base, near, dense]).astype(np.uint64))
    signed = points.view(np.int64).tolist()
    want = plain_groups(signed, points)
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    from scriptorium.llm._components import components

    links = simhash.near_links(df, shard_size=200, sample=500)
    assert links.count() < 4 * len(points)
    root = {r.node: r.root for r in components(links).collect()}
    for x in signed:
        assert root.get(x, x) == want[x]
    assert simhash.near_links(df, shard_size=10**6).count() <= len(points)


def test_no_shard_outgrows_its_bound(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    ball = [base[0] ^ np.uint64(1 << a | 1 << b | 1 << c) for a in range(24) for b in range(a) for c in range(b)]  # no tree parts these
    points = np.unique(np.concatenate([base, ball]).astype(np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in points], "fp long").repartition(5)
    dealt = simhash.deal_shards(df, shard_size=300, sample=200)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert max(sizes) <= 600 and len(sizes) > 10
    from scriptorium.llm._components import components

    root = {r.node: r.root for r in components(simhash.near_links(df, shard_size=300, sample=200)).collect()}
    want = plain_groups(points.tolist(), points.view(np.uint64))
    assert all(root.get(x, x) == want[x] for x in points.tolist())


def test_one_id_with_two_texts_loses_only_copies(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight"
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (6, b, "z"), (5, b, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    for keep in (simhash.keep_one, near_copies.keep_one):
        assert sorted(tuple(r) for r in keep(df).collect()) == [(1, a, "x"), (5, b, "z")]


def test_null_ids_group_but_do_not_name(spark):
    df = spark.createDataFrame([(None, "same text here"), (7, "same text here"), (None, "other words in it")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}
    assert simhash.keep_one(df).count() == 3


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = language_id.train(docs)
    rows = {i: t for i, t in rows.items() for p in [model.predict([t])[0]] if p[0] != "und" and not p[2]}
    judged = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    rows = {i: t for i, t in rows.items() if judged[i]}
    group = plain_least(plain_sets(rows.items()))  # five-word shingles, similarity 0.8 or more
    rows = {i: t for i, t in rows.items() if group[i] == i}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(rows)
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
        assert r.length <= packing.CAPACITY
    assert all(size[r.doc_id] == r.doc_tokens for r in got)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_keep_columns_and_bear_odd_rows(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(90))
    rows = [(1, text, "en", "s", 1), (2, text, "en", None, 1), (2, text, "en", None, 1), (3, None, None, None, None), (None, text, "en", "s", 1), (4, "", "de", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs, n in ((df, 2), (df.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == df.columns
            docs = spark.createDataFrame(out.collect(), df.schema)
        assert docs.count() == n  # the first copy, and the row without an id
