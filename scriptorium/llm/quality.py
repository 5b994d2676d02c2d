"""Quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a predicate over the text that is true where a document is to be
rejected.  Cost and selectivity of each rule are measured on a sample, and the
rules are nested in order of rejections per second, so that most bad documents
never reach the expensive rules.  The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import let, materialize, words_of

#: Fixed thresholds of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES_PER_LINE = 0.5
MEAN_WORD_CHARS = (2.0, 14.0)
MAX_UPPER_PER_CHAR = 0.5
SYMBOLS = r"[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``reject`` maps the row's statistics to a boolean column."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeat_words(words: Column) -> Column:
    """Number of words inside a 3-word window that occurs twice or more.

    Windows are compared by a 64-bit hash, sorted with their positions; equal
    neighbours are repeats, and their positions are swept for the union of
    covered words.  n log n in the length of the text.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def repeated(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            )
            return F.sort_array(F.transform(same, lambda x: x["p"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            let(pairs, repeated),
            start,
            lambda a, p: F.struct(
                (p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")
            ),
            lambda a: a["n"],
        )

    def of(w: Column) -> Column:
        return let(
            windows(w),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, of))


def _free(name: str, taken) -> str:
    while name in taken:
        name += "_"
    return name


def _make_room(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with its columns of these names (in any case) renamed: underscores are
    put behind them until the name is free."""
    taken = {c.lower() for c in docs.columns} | {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            free = _free(c.lower(), taken)
            taken.add(free)
            docs = docs.withColumnRenamed(c, c + free[len(c) :])
    return docs


def text_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add the base statistics of ``text_col`` under ``prefix`` + name.

    A null text counts as an empty one.  Adds: n_words, word_chars (code points
    in words), n_symbols, n_dup_lines, n_repeat_words, all long.  A column of
    ``docs`` that has such a name already keeps its values under that name with an
    underscore behind it.  Texts of any length are read whole.
    """
    docs = _make_room(docs, [prefix + n for n in STATISTICS])
    hidden = _free("words_of_text", {c.lower() for c in docs.columns})
    stats = _stats_of(F.coalesce(F.col(text_col), F.lit("")), F.col(hidden))
    return (
        docs.withColumn(hidden, words_of(F.col(text_col)))
        .withColumns({f"{prefix}{n}": c for n, c in stats.items() if n != "text"})
        .drop(hidden)
    )


#: The base, as rules: they count first for ``judge`` and take their turn in ``keep_good``.
BASE_RULES: tuple[Rule, ...] = (
    Rule("too_short", lambda s: s["n_words"] < MIN_WORDS),
    Rule("repeats", lambda s: 100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"]),
)

#: The rules of the cascade proper; ``s`` holds the statistics and the text.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda s: s["n_symbols"] > MAX_SYMBOLS_PER_WORD * s["n_words"]),
    Rule(
        "word_length",
        lambda s: (s["word_chars"] < MEAN_WORD_CHARS[0] * s["n_words"])
        | (s["word_chars"] > MEAN_WORD_CHARS[1] * s["n_words"]),
    ),
    Rule(
        "duplicate_lines",
        lambda s: s["n_dup_lines"] > MAX_DUP_LINES_PER_LINE * F.size(_lines(s["text"])),
    ),
    Rule(
        "shouting",
        lambda s: F.regexp_count(s["text"], F.lit(r"[A-Z]")) > MAX_UPPER_PER_CHAR * s["word_chars"],
    ),
)


def _stats_columns(text_col: str, prefix: str) -> dict[str, Column]:
    return {n: F.col(f"{prefix}{n}") for n in STATISTICS} | {"text": F.coalesce(F.col(text_col), F.lit(""))}


def _stats_of(text: Column, words: Column) -> dict[str, Column]:
    """The same statistics as expressions over ``words``, each evaluated where used."""
    return {
        "text": text,
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def base_failed(s: dict[str, Column]) -> Column:
    return BASE_RULES[0].reject(s) | BASE_RULES[1].reject(s)


def order_rules(
    docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7
) -> list[dict]:
    """Measure every rule on a sample and sort by rejections per second.

    A rule's time is that of the statistics it needs, from the text on.
    ``sample_rows`` is the expected size of the sample, which is drawn in as many
    tasks as the table has; it decides the order alone.  Each entry: rule, seconds
    (per row), rejected (share).
    """
    rows = docs.count()
    if not rows:
        return [{"rule": r, "seconds": 0.0, "rejected": 0.0} for r in rules]
    drawn = docs.select(F.col(text_col).alias("text")).sample(False, min(1.0, sample_rows / rows), seed)
    sample = materialize(drawn.repartition(4), "sample").persist(StorageLevel.MEMORY_AND_DISK)

    def rejects(rule: Rule) -> Column:
        text = F.coalesce("text", F.lit(""))
        return let(words_of(text), lambda w: rule.reject(_stats_of(text, w)))

    try:
        shares = sample.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(rejects(r)).alias(f"r{i}") for i, r in enumerate(rules)],
        ).first()
        n = max(1, shares["n"])

        def seconds(frame: DataFrame) -> float:
            took = []
            for _ in range(2):
                t = time.perf_counter()
                frame.write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - t)
            return min(took)

        idle = seconds(sample.select(F.lit(True).alias("x")))
        measured = [
            {
                "rule": r,
                "seconds": max(1e-9, (seconds(sample.select(rejects(r).alias("x"))) - idle) / n),
                "rejected": shares[f"r{i}"] / n,
            }
            for i, r in enumerate(rules)
        ]
    finally:
        sample.unpersist()
    return sorted(measured, key=lambda m: (-m["rejected"] / m["seconds"], m["rule"].name))


def cascade(s: dict[str, Column], ordered: list[Rule]) -> Column:
    """True where no rule rejects; later rules are evaluated only for survivors."""
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(F.coalesce(rule.reject(s), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, text_col: str = "text", prefix: str = "", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept`` added under ``prefix``.

    Null and empty texts have no words and fail the base.  Repeated rows are
    judged alike; other columns pass through, renamed where a name clashes as
    ``text_stats`` does it.  All statistics are wanted here, so the cascade saves
    only what its rules add to them; ``keep_good`` leaves out those not needed.
    """
    ordered = [m["rule"] for m in order_rules(docs, text_col, rules)]
    s = _stats_columns(text_col, prefix)
    docs = _make_room(docs, [f"{prefix}base_failed", f"{prefix}kept"])
    out = text_stats(docs, text_col, prefix).withColumn(f"{prefix}base_failed", base_failed(s))
    return out.withColumn(
        f"{prefix}kept", F.when(F.col(f"{prefix}base_failed"), F.lit(False)).otherwise(cascade(s, ordered))
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass the base and all rules, with the columns of ``docs``.

    The words are found once; statistics are computed as far as the cascade goes.
    Null and empty texts go; repeated rows and all columns are kept as they are;
    texts of any length are read whole.
    """
    ordered = [m["rule"] for m in order_rules(docs, text_col, BASE_RULES + RULES)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.filter(let(words_of(text), lambda w: cascade(_stats_of(text, w), ordered)))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row of ``documents``; see ``judge`` for nulls,
    empty and long texts, repeated rows and clashing names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).drop("text")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS tri
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 4)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM c WHERE n >= 2) GROUP BY rid),
s AS (SELECT doc_id, t, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT (n_symbols > 0.1::DOUBLE * n_words)
   AND NOT (word_chars < 2.0::DOUBLE * n_words OR word_chars > 14.0::DOUBLE * n_words)
   AND NOT (n_dup_lines > 0.5::DOUBLE * len(ls))
   AND NOT ((length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 0.5::DOUBLE * word_chars)) AS kept
FROM b
"""
