"""escaped_latex returns every document, also those its SQL leaves out."""

import hashlib
import re

from scriptorium import queries


def plain(t):
    t = re.sub(r"(?<!\\)([&%$#_])", r"\\\1", t or "")
    t = re.sub(r"(?<!\\)~", lambda m: "\\~{}", t)
    return re.sub(r"(?<!\\)\^", lambda m: "\\^{}", t)


def test_documents_with_tilde_caret_and_backslash(spark, tmp_path):
    texts = [None, "", "plain", "a_b & 5%", "~user/x^2", r"C:\dir\_x", r"\~ \^ \& ~~ ^^ \\_ $#", "http://a/~b_c\n\\alpha_1^2"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.escaped for r in queries.QUERIES["escaped_latex"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(plain(t).encode()).hexdigest() for i, t in enumerate(texts)}
