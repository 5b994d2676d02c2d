"""Whole-text encoding by a public vocabulary, with a cache of word units.

A text is cut where the vocabulary's pattern cuts as well: at line ends and
before single spaces between visible characters.  The pieces repeat a lot, so
each is encoded once and its ids, as bytes, are looked up afterwards.  Texts in
which white space touches white space, or which hold one of the vocabulary's added
tokens (the library finds these before it cuts), are encoded whole, without the cache.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

from ._util import worker_state

#: White space next to white space, by Python's wider class: there, cuts are not sure.
_TOUCHING = re.compile(r"\s\s")
#: ASCII marks that end a word; a run of them is one piece of the pattern.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE_UNITS = 1_000_000
#: Of these a worker's encoder keeps: some 100 MB.
ENCODER_UNITS = 600_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name_or_path: str) -> str:
    """A path as it is; a bare name inside the public tokenizers' folder."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class UnitCache:
    """Encodes batches of texts; ``encode_units(list of str, prefix) -> list of values``.

    ``join(parts)`` puts the values of consecutive units together and
    ``whole(text)`` encodes a text that can't be cut.  Memory is bounded by
    ``limit`` units.  If ``batched``, new units are encoded for all texts of a call
    together, and the cache starts anew when it is full.  Else they are encoded line by
    line, and the cache has two halves: a full young half becomes the old one, from
    which units that come again return, so that frequent words are never lost.
    """

    def __init__(self, encode_units, join, limit: int = CACHE_UNITS, batched: bool = True, added: tuple[str, ...] = ()):
        self.encode_units, self.join, self.limit, self.batched, self.added = encode_units, join, limit, batched, added
        self.spaced: dict = {}  # unit without its leading space
        self.plain: dict = {}
        self.old_spaced: dict = {}
        self.old_plain: dict = {}
        self.newline = encode_units(["\n"])[0]

    def _uncut(self, text: str) -> bool:
        return bool(_TOUCHING.search(text)) or any(a in text for a in self.added)

    def _fill(self, cache: dict, units: set, prefix: str) -> None:
        missing = list(units.difference(cache))
        if len(cache) + len(missing) > self.limit:
            cache.clear()
            missing = list(units)
        for lo in range(0, len(missing), 4096):
            some = missing[lo : lo + 4096]
            cache.update(zip(some, self.encode_units(some, prefix)))

    def encode(self, texts: list[str | None]) -> list:
        """Values of the texts, null as empty.  The many small lists made here hold
        no cycles, so the collector of cycles rests meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts) if self.batched else list(map(self._encode_one, texts))
        finally:
            if was:
                gc.enable()

    def _encode_one(self, text: str | None):
        if not text:
            return self.join([])
        if self._uncut(text):
            return self.encode_units([text])[0]
        if len(self.spaced) + len(self.plain) > self.limit // 2:
            self.old_spaced, self.old_plain, self.spaced, self.plain = self.spaced, self.plain, {}, {}
        plain, spaced, known, parts = self.plain, self.spaced, self.spaced.get, []
        earlier = self.old_spaced.pop
        for i, line in enumerate(text.split("\n")):
            units = line.split(" ")
            head = units[0]
            values = list(map(known, units))
            values[0] = plain.get(head)
            if values[0] is None:
                values[0] = self.old_plain.pop(head, None)
                if values[0] is None:
                    values[0] = self.encode_units([head])[0] if head else self.join([])
                plain[head] = values[0]
            if None in values:
                new = []
                for k, v in enumerate(values):
                    if v is None:
                        v = earlier(units[k], None)
                        if v is None:
                            new.append(k)
                        else:
                            values[k] = spaced[units[k]] = v
                if new:
                    for k, v in zip(new, self.encode_units([units[k] for k in new], " ")):
                        values[k] = spaced[units[k]] = v
            if i:
                parts.append(self.newline)
            parts += values
        return self.join(parts)

    def _encode(self, texts: list[str | None]) -> list:
        cut: list = []
        first, rest = set(), set()
        for text in texts:
            if not text:
                cut.append(None)
            elif self._uncut(text):
                cut.append(text)
            else:
                lines = [line.split(" ") for line in text.split("\n")]
                for line in lines:
                    first.add(line[0])
                    rest.update(line[1:])
                cut.append(lines)
        self._fill(self.plain, first, "")
        self._fill(self.spaced, rest, " ")
        plain, spaced, out = self.plain, self.spaced, []
        for item in cut:
            if item is None:
                out.append(self.join([]))
            elif isinstance(item, str):
                out.append(self.encode_units([item])[0])
            else:
                parts: list = []
                for i, line in enumerate(item):
                    if i:
                        parts.append(self.newline)
                    if line[0]:
                        parts.append(plain[line[0]])
                    parts += map(spaced.__getitem__, line[1:])
                out.append(self.join(parts))
        return out


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


def _unit_encoder(tok):
    """encode_units for a byte-level tokenizer.

    A unit that is one word of Latin letters, with marks after it, is two pieces
    of the pattern: both go straight to the library's merge model, and marks are
    remembered.  Any other unit takes the library's whole path.
    """
    model, letters = tok.model, _byte_letters()
    tails: dict[str, bytes] = {"": b""}

    def packed(ids) -> bytes:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def latin(text: str) -> bool:
        try:
            return bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def piece(text: str) -> bytes:
        if text not in tails:
            if len(tails) > 10_000:
                tails.clear()
                tails[""] = b""
            tails[text] = packed(tok.encode(text, add_special_tokens=False).ids)
        return tails[text]

    tokenize, space = model.tokenize, letters[32]

    def encode_units(units, prefix=""):
        out, rest = [], []
        lead = space if prefix == " " else ""
        for u in units:
            bare = u if u.isalpha() else u.rstrip(_MARKS)
            if bare.isascii() and bare.isalpha():
                found = packed([t.id for t in tokenize(lead + bare)])
            elif bare.isalpha() and latin(bare):
                found = packed([t.id for t in tokenize(lead + bare.encode().decode("latin-1").translate(letters))])
            else:
                rest.append((len(out), prefix + u))
                out.append(b"")
                continue
            out.append(found if bare is u else found + piece(u[len(bare) :]))
        if rest:
            for (k, _), e in zip(rest, tok.encode_batch_fast([u for _, u in rest], add_special_tokens=False)):
                out[k] = packed(e.ids)
        return out

    return encode_units


def public_encoder(vocabulary: str = VOCABULARY) -> UnitCache:
    """The worker's encoder for a byte-level ``tokenizers`` file: text to u32 ids."""
    state = worker_state("tokens")
    path = vocabulary_path(vocabulary)
    if ("encoder", path) not in state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        state["encoder", path] = UnitCache(_unit_encoder(tok), b"".join, ENCODER_UNITS, batched=False, added=added)
    return state["encoder", path]


def slices(batches, rows: int = 128, most_chars: int = 1_000_000):
    """Small runs of (doc_ids, texts) out of Arrow batches: bounded working memory."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1)):
            ids.append(i.as_py())
            texts.append(t.as_py())
            size += len(texts[-1] or "")
            if len(ids) >= rows or size >= most_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts
