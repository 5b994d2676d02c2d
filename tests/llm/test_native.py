"""URL filters, chat formatting and quality rules against plain Python."""

import datetime as dt
import random

from scriptorium.llm import chat, quality, url_filters

DAY = dt.date


def test_temporal_list_join(spark):
    entries = spark.createDataFrame(
        [
            ("bad.com", "block", DAY(2024, 1, 10)),
            ("bad.com", "clear", DAY(2024, 2, 1)),
            ("ok.bad.com", "allow", DAY(2024, 1, 15)),
            ("bad.com/spam", "block", DAY(2024, 3, 1)),
            ("tie.org", "block", DAY(2024, 1, 1)),
            ("tie.org", "allow", DAY(2024, 1, 1)),
            ("tie.org", "block", DAY(2024, 1, 1)),
            (None, "block", DAY(2024, 1, 1)),
            ("x.com", None, DAY(2024, 1, 1)),
        ],
        "pattern string, action string, effective_on date",
    )
    rows = [
        (1, "http://bad.com/", DAY(2024, 1, 9), "none", None),
        (2, "http://www.BAD.com/a", DAY(2024, 1, 10), "block", "bad.com"),
        (3, "http://ok.bad.com/a", DAY(2024, 1, 14), "block", "bad.com"),
        (4, "http://ok.bad.com/a", DAY(2024, 1, 15), "allow", "ok.bad.com"),
        (5, "http://bad.com/a", DAY(2024, 2, 1), "none", None),
        (6, "https://u:p@bad.com:81/spam/x?y", DAY(2024, 3, 2), "block", "bad.com/spam"),
        (7, "http://tie.org", DAY(2024, 1, 1), "allow", "tie.org"),
        (8, None, DAY(2024, 1, 1), "none", None),
        (9, "not a url", DAY(2024, 1, 1), "none", None),
        (10, "http://bad.com/", None, "none", None),
        (10, "http://bad.com/", None, "none", None),
        (None, "http://tie.org/", DAY(2024, 5, 1), "allow", "tie.org"),
    ]
    captures = spark.createDataFrame([r[:3] + ("x", "y") for r in rows], "page_id long, url string, fetched_on date, host string, verdict string")
    got = url_filters.judge(captures, entries).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.page_id, r.url, r.fetched_on, r.verdict, r.matched) for r in got), key=key) == sorted(rows, key=key)
    assert url_filters.keep_allowed(captures, entries).count() == len(rows) - 3
    assert url_filters.judge(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filters.judge(captures, entries.limit(0)).collect()} == {"none"}


def brute_chats(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    turns = {c: tuple(v[2:] for v in sorted(k)) for c, k in by.items()}
    out = {}
    for c, mine in turns.items():
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for o in turns.values())
        same = [d for d, o in turns.items() if o == mine]
        ids = [d for d in same if d is not None]
        if not longer and (c == min(ids) if ids else True):
            text = "".join(f"<|{r}|>\n{x}\n<|end|>\n" for _, r, _, x in mine)
            out[c] = (len(mine), len(same), text)
    return out


def test_snapshots_collapse(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        n = rng.randint(1, 5)
        rows += [(c, t, ["user", "assistant"][t % 2], rng.choice(["a", "b"])) for t in range(n)]
    rows += [(500, t, "user", "long") for t in range(700)] + [(501, t, "user", "long") for t in range(699)]
    rows += [(502, t, "user", "long") for t in range(700)]
    rows += [(None, 0, "user", "lost"), (600, None, None, None), (601, 0, "", ""), (602, 0, "user", "t"), (602, 0, "user", "t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ord int")
    got = {}
    for r in sorted(chat.format_chats(df).collect(), key=lambda r: (str(r.conv_id), r.part)):
        n, k, text = got.get(r.conv_id, (r.n_turns, r.copies, ""))
        got[r.conv_id] = (n, k, text + r.rendered)
    assert got == brute_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversations_equal_sql(spark):
    """Parts, carried sums and the SQL on conversations of more than 256 turns, some of one turn number."""
    import duckdb
    import pandas as pd

    rng = random.Random(8)
    rows = [(c, t if c % 2 else 5, rng.choice(["user", None]), f"{t % 50}") for c in range(6) for t in range(300 + 90 * c)]
    rows += [(c + 10, t, r, x) for c, t, r, x in rows if c in (1, 3) and t < 280]  # cut copies
    rows += [(None, t, "user", f"lone {t}") for t in range(600)]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})  # noqa: F841
    want = sorted(map(str, duckdb.sql(chat.OP5_SQL).fetchall()))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = chat.format_chats(df).select("conv_id", "part", "n_turns", "copies", "rendered").collect()
    assert sorted(str(tuple(r)) for r in got) == want and {r.conv_id for r in got} == {*range(6), None}


def test_hot_hosts_and_suffixes(spark, monkeypatch):
    from scriptorium.llm import _util

    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example.com/{i % 5}", DAY(2024, 1, 1 + i % 28)) for i in range(6000)] + [(9000 + i, None, DAY(2024, 1, 1)) for i in range(3000)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date")
    entries = spark.createDataFrame(
        [("hot.example.com", "block", DAY(2024, 1, 5)), ("example.com", "allow", DAY(2024, 1, 9)), ("hot.example.com/2", "clear", DAY(2024, 1, 1)), ("com", "block", DAY(2024, 1, 20)), ("hot.example.com", "clear", DAY(2024, 1, 25))],
        "pattern string, action string, effective_on date",
    )
    want = sorted(map(str, url_filters.judge(captures, entries).collect()))
    monkeypatch.setattr(_util, "HOT_KEYS", 1)  # no key counts as hot
    assert sorted(map(str, url_filters.judge(captures, entries).collect())) == want
    assert sum("'block'" in x for x in want) > 2000 and sum("'allow'" in x for x in want) > 1000


def plain_stats(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, t in enumerate(tri) if tri.count(t) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics_and_cascade(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c a b c", "a a a a a", "é ñ\x85x 😀", "x\n\nx\n x\nx", "one two"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(30)]
    clean = " ".join(f"word{i}" for i in range(80))
    texts += [clean, clean.upper(), clean.replace(" ", "### "), clean.replace("word", "w" * 40), clean + "\n" + "\n".join(["line of text"] * 30)]
    texts.append(" ".join(f"w{i % 5000}" for i in range(60000)))
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.judge(df, prefix="q_").collect()}
    for i, t in enumerate(texts[:-1]):
        r = got[i]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == plain_stats(t), repr(t)[:80]
    assert got[len(texts) - 1].q_n_repeat_words == 60000
    kept = [i for i, r in got.items() if r.q_kept]
    assert kept == [38]
    good = quality.keep_good(df)
    assert good.columns == df.columns and [r.doc_id for r in good.collect()] == kept
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_clashing_columns_keep_their_values(spark):
    df = spark.createDataFrame([("a b c", 7, "mine", True, "x")], "text string, n_words int, words string, Kept boolean, n_words_ string")
    row = quality.judge(df).first().asDict()
    assert (row["n_words"], row["n_words__"], row["n_words_"], row["words"], row["Kept_"], row["kept"]) == (3, 7, "x", "mine", True, False)
    assert quality.text_stats(df).first()["words"] == "mine"


def test_rule_order_does_not_change_verdicts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" ".join(["AB#"] * k + [f"c{j}" for j in range(60)]),) for k in range(0, 60, 5)], "text string")
    stats = quality.text_stats(df)
    s = quality._stats_columns("text", "")
    a = stats.select(quality.cascade(s, list(quality.RULES)).alias("k"), "text")
    b = stats.select(quality.cascade(s, list(quality.RULES[::-1])).alias("k"), "text")
    assert a.exceptAll(b).count() == 0 and a.filter(F.col("k")).count() > 0
    ordered = quality.order_rules(df)
    assert {m["rule"].name for m in ordered} == {r.name for r in quality.RULES}
