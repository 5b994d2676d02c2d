"""Operators whose state built-in functions can't carry: one Arrow-batched Python
hop each, over one value or one document's sections at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from .. import constants as K
from .. import schema as S

@F.pandas_udf(S.TEXT)
def mark_subsections(content: pd.Series) -> pd.Series:
    """``A. Title words`` to a subsection: the title ends before a word that begins a
    body, or after four words; a single word stays prose, without its letter."""
    pattern = re.compile(r"(?<!\\subsection\{)(^|\s)[A-Z]\.\s+([A-Za-z][A-Za-z'\-]*(?:\s+[A-Za-z][A-Za-z'\-]*){0,7})")

    def rewrite(m: re.Match) -> str:
        words = m.group(2).split()
        stop = next((i for i, w in enumerate(words) if i and w in K.BODY_STARTS), len(words))
        n = min(stop, 4 if len(words) > 4 else len(words))
        if n < 2 and stop == len(words):
            return m.group(1) + m.group(2)
        rest = " ".join(words[n:])
        return f"{m.group(1)}\\subsection{{{' '.join(words[:n])}}}{' ' + rest if rest else ''}"

    return content.map(lambda t: pattern.sub(rewrite, t) if t else t)


#: A trigger with its star, and the name where the name follows the trigger itself.
_HEAD = re.compile("|".join(re.escape(t) + (r"[A-Za-z@]+\*?" if t.endswith("\\") else r"\*?") for t in sorted(K.MACRO_TRIGGERS, key=len, reverse=True)))
_EQUALS = re.compile(r"\s*=?\s*\\[A-Za-z@]+\*?")
_GROUP = re.compile(r"\s*([{\[])")


def closing_braces(text: str) -> dict[int, int]:
    """For each balanced opening brace the offset behind its partner, in one pass."""
    partner, open_ = {}, []
    for m in re.finditer(r"\\.|[{}]", text, re.S):
        if m.group() == "{":
            open_.append(m.start())
        elif m.group() == "}" and open_:
            partner[open_.pop()] = m.end()
    return partner


def macros_of(preamble: str) -> list[str]:
    """Definitions of a preamble, distinct, in order; comments hide what they hold."""
    text = re.sub(r"%[^\n]*", "", preamble)
    partner, found, behind = closing_braces(text), {}, 0
    for head in _HEAD.finditer(text):
        if head.start() < behind:  # inside the definition before
            continue
        end, most = head.end(), 600
        if head.group().startswith("\\let"):
            value, most = _EQUALS.match(text, end), 200
            end = value.end() if value else end
        else:
            for _ in range(5):  # name, number of arguments, default, bodies
                group = _GROUP.match(text, end)
                close = group and (partner.get(group.start(1)) if group[1] == "{" else text.find("]", group.end()) + 1)
                if not close:
                    break
                end = close
        behind = end
        line = " ".join(text[head.start() : end].split())
        if len(line) <= most and not line.startswith(tuple(K.MACRO_SKIPS)):
            found.setdefault(line)
    return list(found)


@F.pandas_udf(S.STRINGS)
def custom_macros(preamble: pd.Series) -> pd.Series:
    """Macro definitions of a preamble with balanced groups, each on one line."""
    return preamble.map(lambda t: macros_of(t or ""))


@F.pandas_udf(S.REFERENCES)
def reference_placeholders(text: pd.Series) -> pd.Series:
    """Entries behind a references heading, the first of equal keys; without any, one
    placeholder for every distinct ``[n]`` of the text."""

    def one(t: str) -> list[dict]:
        block = re.search(r"(?is)(?:^|\n)(?:REFERENCES|BIBLIOGRAPHY|WORKS\s+CITED)\s*(.*)$", t or "")
        found: dict[str, str] = {}
        for n, raw in re.findall(r"(?s)\[(\d+)\]\s*(.*?)(?=\[\d+\]|\Z)", block.group(1) if block else ""):
            if raw.strip():
                found.setdefault(f"ref{n}", " ".join(raw.split()))
        for n in [] if found else re.findall(r"\[(\d+)\]", t or ""):
            found.setdefault(f"ref{n}", f"placeholder for ref{n}")
        return [{"key": k, "raw": v} for k, v in found.items()]

    return text.map(one)
