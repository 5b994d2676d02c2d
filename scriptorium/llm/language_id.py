"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  One binary n-gram classifier per bit
tells the languages with that bit set from the others, by the mean log-odds of
hashed byte bigrams and trigrams.  Decoding picks the codeword of least loss, a
classifier's loss being weighted by how well it did on each language in
validation; a text is flagged ambiguous where two codewords are almost as near.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import mapped, materialize, worker_state

#: Hash buckets of each n-gram order.
BUCKETS = 1 << 15
#: Bound of the labelled sample, in documents, shared evenly by the languages; one
#: document of a language at least.
MAX_SAMPLE = 6000
#: Bytes and texts that are taken apart at once.
STEP, RUN = 1 << 20, 64
#: Least difference of scores between the two nearest codewords.
AMBIGUOUS = 0.02
UNDETERMINED = "und"


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """(k, bits) matrix of -1 and 1.  Exhaustive codes for up to five languages;
    beyond, the best of some random dense codes by least row distance."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.int8)
    if k <= 5:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(columns, dtype=np.int8).T
    bits, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, bits))
        if (abs(m.sum(axis=0)) == k).any():
            continue
        d = (bits - m.astype(int) @ m.T.astype(int)) // 2 + np.eye(k, dtype=int) * bits
        if best is None or d.min() > best[0]:
            best = (d.min(), m)
    return best[1] if best else codewords(k, seed + 1)


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" \0\0"


def _grams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bigram ids, trigram ids), one each for every byte but the last two; n-grams
    that touch a zero byte are 2 * BUCKETS, which has no weight."""
    buffer = np.frombuffer(raw, np.uint8).astype(np.uint32)
    a, b, c = buffer[:-2], buffer[1:-1], buffer[2:]
    pair = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    two = pair >> np.uint32(17)
    three = ((pair + c * np.uint32(0xC2B2AE3D)) >> np.uint32(17)) + np.uint32(BUCKETS)
    none = np.uint32(2 * BUCKETS)
    open_ = (a == 0) | (b == 0)
    two[open_] = none
    three[open_ | (c == 0)] = none
    return two, three


def _windows(raw: bytes):
    """A text's bytes in windows of bounded size that overlap by the two bytes an n-gram needs."""
    for at in range(0, len(raw) - 2, STEP):
        yield raw[at : at + STEP + 2]


def runs(sizes: list[int]):
    """Bounds of runs of at most ``RUN`` texts and, but for a single text, ``STEP`` bytes."""
    lo = size = 0
    for k, n in enumerate(sizes):
        if k > lo and (k - lo >= RUN or size + n > STEP):
            yield lo, k
            lo, size = k, 0
        size += n
    if len(sizes) > lo:
        yield lo, len(sizes)


def sizes_of(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


@dataclass
class Model:
    """Languages, codewords, weights (2 * BUCKETS + 1, bits) and decoding weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """(texts, bits): mean log-odds of each text's n-grams."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for k, t in enumerate(texts):
            raw = _bytes(t)
            for window in _windows(raw):
                for ids in _grams(window):
                    out[k] += self.weights[ids].sum(axis=0, dtype=np.float64)
            out[k] /= len(raw) - 2
        return out

    def losses(self, margins: np.ndarray, scale: float = 4.0) -> np.ndarray:
        """(texts, languages): loss-weighted distance to each codeword."""
        signed = self.code[None, :, :] * margins[:, None, :] * scale
        return (self.bit_weights[None] * np.logaddexp(0, -signed)).sum(axis=2)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        out: list = [(UNDETERMINED, 0.0, True)] * len(texts)
        at = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not at or not self.languages:
            return out
        losses = self.losses(self.margins([texts[k] for k in at])) * 4
        p = np.exp(losses.min(axis=1, keepdims=True) - losses)
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        for row, k in enumerate(at):
            best = p[row, order[row, 0]]
            second = p[row, order[row, 1]] if p.shape[1] > 1 else 0.0
            out[k] = (self.languages[order[row, 0]], float(min(1.0, best)), bool(best - second < AMBIGUOUS))
        return out


def count_grams(texts, counts: np.ndarray | None = None) -> np.ndarray:
    """How often each n-gram occurs in the texts, added to ``counts``."""
    counts = np.zeros(2 * BUCKETS + 1, np.int64) if counts is None else counts
    for t in texts:
        for window in _windows(_bytes(t)):
            for ids in _grams(window):
                counts += np.bincount(ids, minlength=len(counts))
    return counts


def model_of(names: list[str], counts: np.ndarray) -> Model:
    """The model for sorted ``names`` from their (languages, n-grams) counts; all bits
    weigh the same until validation says otherwise."""
    code = codewords(len(names))
    share = np.empty((len(names), 2 * BUCKETS))  # of an n-gram within its order, smoothed
    for lo in (0, BUCKETS):
        part = counts[:, lo : lo + BUCKETS] + 0.5
        share[:, lo : lo + BUCKETS] = part / part.sum(axis=1, keepdims=True)
    weights = np.zeros((2 * BUCKETS + 1, code.shape[1]), dtype=np.float32)
    for j in range(code.shape[1]):
        on, off = share[code[:, j] > 0], share[code[:, j] < 0]
        if len(on) and len(off):
            weights[:-1, j] = np.log(on.mean(axis=0) / off.mean(axis=0))
    return Model(names, code, weights, np.full(code.shape, 1.0 / code.shape[1]))


def right_bits(model: Model, language: str, texts: list[str]) -> np.ndarray:
    """For how many of the texts each bit's classifier is right."""
    return (model.margins(texts) * model.code[model.languages.index(language)] > 0).sum(axis=0)


def weigh(model: Model, right: np.ndarray, total: np.ndarray) -> Model:
    """Set the decoding weights from the right answers of each language and bit."""
    accuracy = (right + 1.0) / (total[:, None] + 2.0)
    model.bit_weights = accuracy / accuracy.sum(axis=1, keepdims=True)
    return model


def fit(texts: list[str], languages: list[str]) -> Model:
    """Fit on labelled texts at hand: of each language three texts of four give the
    log-odds, the fourth the decoding weights."""
    names = sorted(set(languages))
    own = {n: [t for t, x in zip(texts, languages) if x == n] for n in names}
    counts = [count_grams(t for k, t in enumerate(own[n]) if k % 4 < 3) for n in names]
    model = model_of(names, np.array(counts).reshape(len(names), -1))
    held = {n: own[n][3::4] for n in names}
    return weigh(model, np.array([right_bits(model, n, held[n]) for n in names]), np.array([len(held[n]) for n in names]))


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id's decimal text is divisible by five (false for null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``(lang, text, checks)`` of a bounded, repeatable sample of ``docs(doc_id, text,
    lang)``, as even between languages as they allow; ``checks`` marks every fourth.

    Rows with a null in doc_id, text or lang take no part.  Only the number of rows of
    each language reaches the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    each = max(1, max_sample // max(1, len(sizes)))
    lot = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    pairs = [F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))]
    share = F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(0.0)
    checks = F.pmod(F.xxhash64(F.lit("checks"), "doc_id"), F.lit(4)) == 0
    return known.filter(lot < share).select("lang", "text", checks.alias("checks"))


def train(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    """A model from the rows of ``docs`` that aren't held out.

    A language's sampled texts are counted in one task, text by text, and its counts
    alone (half a MB a language) reach the driver; likewise its right answers.
    """
    sample = materialize(labelled_sample(docs.filter(~held_out(F.col("doc_id"))), max_sample), "labelled")

    def counted(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lang, t in zip(langs, texts):
                counts[lang] = count_grams([t.as_py()], counts.get(lang))
        for lang, c in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [c.tobytes()]})

    # a language whose sample is all for checking is known, but without n-grams of its own
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not names:
        return Model([], np.ones((0, 1), np.int8), np.zeros((2 * BUCKETS + 1, 1), np.float32), np.ones((0, 1)))
    rows = mapped(sample.filter("NOT checks").select("lang", "text").repartition("lang"), counted, "lang string, counts binary").collect()
    got = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    model = model_of(names, np.array([got.get(n, np.zeros(2 * BUCKETS + 1, np.int64)) for n in names]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x bits

    def checked(batches):
        model = shared.value
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lang, t in zip(langs, texts):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([right_bits(model, lang, [t.as_py()]).tolist()], pa.list_(pa.int64()))], names=["lang", "ok"])

    each = mapped(sample.filter("checks").select("lang", "text"), checked, "lang string, ok array<long>")
    bits = [F.sum(F.get("ok", F.lit(j))).alias(f"b{j}") for j in range(model.code.shape[1])]
    right, total = np.zeros(model.code.shape), np.zeros(len(names))
    for r in each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *bits).collect():
        k = names.index(r["lang"])
        right[k], total[k] = [r[f"b{j}"] for j in range(right.shape[1])], r["n"]
    shared.unpersist()
    return weigh(model, right, total)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)``, one row per row of ``docs``.

    The prediction uses the whole text alone, whatever its length, in bounded memory.
    Null texts and texts without a letter are ``und`` with score 0 and count as
    ambiguous; so does everything where no language was learned.  Of equally near
    codewords the first language in order is named; repeated rows are judged alike;
    other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x bits

    def run(batches):
        worker_state("language")
        model = shared.value
        for batch in batches:
            for lo, hi in runs(sizes_of(batch.column(2))):
                part = batch.slice(lo, hi - lo)
                rows = model.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return mapped(named, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is clear, with the columns of ``docs``.

    Null texts, texts without a letter and ambiguous ones go; repeated rows stay.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        worker_state("language")
        model = shared.value
        for batch in batches:
            for lo, hi in runs(sizes_of(batch.column(at))):
                part = batch.slice(lo, hi - lo)
                rows = model.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([r[0] != UNDETERMINED and not r[2] for r in rows], pa.bool_()))

    return mapped(docs, run, docs.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every row of ``documents``; see ``identify`` for nulls, empty and
    long texts, ties and repeated rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
