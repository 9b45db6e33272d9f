"""BPE encoding and decoding by forced boundaries.

A merge can only build a vocabulary token, so two neighbouring bytes that stand next to each other in no token are never
merged: every such place is a certain cut. A text falls into fragments at its certain cuts, each distinct fragment is
encoded once by itself, and the pieces are put together again.
"""
from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from modalframe.llm.text import map_texts, words

#: Distinct words whose encoding a worker remembers in each of two generations. A full generation becomes the old one, and words
#: met again move to the new one, so only rare words are forgotten. Bounds the memory of a worker, not the result.
REMEMBERED = 150_000
#: Characters of text whose unknown fragments are encoded in one call.
CHUNK = 1 << 20


_BYTE_CHARS = 512  # byte characters lie below
#: Words of visible characters below this are split by the pattern of the file itself (letters there are alike in all Unicode versions).
_LATIN_END = "\u0530"


def byte_chars() -> dict[int, int]:
    """The character that stands for each byte: itself where it is visible, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 0x100 + k for k, b in enumerate(hidden)}


_TO_BYTE_CHAR = byte_chars()
_PART, _BLANK = (chr(_TO_BYTE_CHAR[b]) for b in b"\0 ")  # neither is found in a pre-token of visible characters


class ForcedBpe:
    """Encoder of one tokenizer file with a word-end suffix, a pre-tokenizer that drops white space and no decoder."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.last = Tokenizer(BPE(model["vocab"], merges, end_of_word_suffix=self.suffix))
        self.inner = Tokenizer(BPE(model["vocab"], merges))
        self.shown = {i: t for t, i in model["vocab"].items()}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre = whole.normalizer, whole.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.joined = np.zeros((_BYTE_CHARS, _BYTE_CHARS), bool)  # byte characters that stand together in some token
        for token in model["vocab"]:
            bare = [ord(c) for c in token.removesuffix(self.suffix)]
            self.joined[bare[:-1], bare[1:]] = True
        self.joined[0, :] = self.joined[:, 0] = True  # 0 is no byte character; it parts pre-tokens below
        blanks = {p for c in " \t\n\x0b\x0c\r" for p, _ in self.pre.pre_tokenize_str(c)}
        if blanks:
            raise ValueError("white space must be no part of any token")
        self.plain = self._plain_split(spec)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def _plain_split(spec: dict):
        """Finds the pre-tokens of normalised words, and the blanks between them, by the pattern of the file; None if more than
        that pattern and the byte mapping is needed."""
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        lower = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if lower and [s["type"] for s in steps] == ["Split", "ByteLevel"]:
            split, level = steps
            if split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]:
                return regex.compile(f"(?:{split['pattern']['Regex']})| ").findall
        return None

    def cut(self, pretokens: list[str]) -> list[list[str]]:
        """Pieces of each pre-token (in byte characters) between its certain cuts."""
        out = [[p] for p in pretokens]
        if not out:
            return out
        code = np.frombuffer("\0".join(pretokens).encode("utf-16-le"), np.uint16)
        cuts = np.flatnonzero(~self.joined[code[:-1], code[1:]]) + 1
        if len(cuts):
            size = np.array([len(p) for p in pretokens])
            begin = np.cumsum(size + 1) - size - 1
            owner = np.searchsorted(begin, cuts, side="right") - 1
            inside: dict[int, list[int]] = {}
            for o, c in zip(owner.tolist(), (cuts - begin[owner]).tolist()):
                inside.setdefault(o, []).append(c)
            for o, at in inside.items():
                out[o] = [pretokens[o][a:b] for a, b in zip([0, *at], [*at, len(pretokens[o])])]
        return out

    def fragments(self, pretoken: str) -> list[str]:
        return self.cut([pretoken])[0]

    def _pretokens(self, part: str) -> list[str]:
        return [p for p, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def _split_plain(self, plain: list[str]) -> list[str] | None:
        """Pre-tokens of many plain words at once, those of a word joined by `_PART`; None if the words cannot be told apart."""
        found = self.plain(self.normalizer.normalize_str(" ".join(plain)))
        out = "\0".join(found).encode().decode("latin-1").translate(_TO_BYTE_CHAR).split(f"{_PART}{_BLANK}{_PART}")
        return out if len(out) == len(plain) and not any(w.startswith(_BLANK) for w in out) else None

    def _learn(self, new: set[str]) -> None:
        """Encode new words: all their distinct fragments in one call for each encoder."""
        plain, joined = [], None
        if self.plain is not None:
            plain = [w for w in new if w.isprintable() and "<" not in w and (w.isascii() or max(w) < _LATIN_END)]
            joined = self._split_plain(plain) if plain else []
        if joined is None:
            plain, joined = [], []
        # Words of one pre-token without a cut are their own and last fragment; the others are taken apart.
        simple = np.ones(len(plain), bool)
        if plain:
            code = np.frombuffer(_PART.join(joined).encode("utf-16-le"), np.uint16)
            parted = ~self.joined[code[:-1], code[1:]]
            parted[code[1:] == ord(_PART)] = False
            parted[code[:-1] == ord(_PART)] = False
            size = np.fromiter(map(len, joined), np.int64, len(joined))
            begin = np.cumsum(size + 1) - size - 1
            simple[np.searchsorted(begin, np.flatnonzero(parted) + 1, side="right") - 1] = False
            inner_parts = np.flatnonzero(code == ord(_PART))
            simple[np.searchsorted(begin, np.setdiff1d(inner_parts, begin - 1, assume_unique=True), side="right") - 1] = False
        flags = simple.tolist()
        easy = {w: j for w, j, f in zip(plain, joined, flags) if f}
        rest = {w: j.split(_PART) for w, j, f in zip(plain, joined, flags) if not f}
        specials = {}
        for w in new.difference(plain) if len(plain) < len(new) else ():
            parts = self.split_special.split(w) if self.split_special and "<" in w else [w]
            rest[w] = []
            for part in parts:
                if part in self.special:
                    specials.setdefault(w, {})[len(rest[w])] = part
                    rest[w].append("")
                else:
                    rest[w] += self._pretokens(part)
        pieces = iter(self.cut([p for ps in rest.values() for p in ps]))
        cut = {w: [next(pieces) for _ in ps] for w, ps in rest.items()}
        last = self._encode(self.last, {*easy.values(), *(p[-1] for ps in cut.values() for p in ps)})
        inner = self._encode(self.inner, {f for ps in cut.values() for p in ps for f in p[:-1]})
        known = self.known
        known.update(zip(easy, map(last.__getitem__, easy.values())))
        for w, ps in cut.items():
            made, special = [], specials.get(w, {})
            for k, p in enumerate(ps):
                if k in special:
                    made.append((array("I", [self.special[special[k]]]).tobytes(), special[k]))
                else:
                    made += [*(inner[f] for f in p[:-1]), last[p[-1]]]
            known[w] = (b"".join([x[0] for x in made]), " ".join([x[1] for x in made]))

    def _encode(self, encoder, fragments: set[str]) -> dict[str, tuple[bytes, str]]:
        wanted, shown, out = list(fragments), self.shown.__getitem__, {}
        for f, e in zip(wanted, encoder.encode_batch_fast(wanted, add_special_tokens=False), strict=True):
            ids = e.ids
            out[f] = (array("I", ids).tobytes(), " ".join(map(shown, ids)))
        return out

    def _chunk(self, chunk: list[list[str]]) -> list[tuple[bytes, str]]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*chunk).difference(known)
        again = older.keys() & new
        for w in again:
            known[w] = older[w]
        new -= again
        if new:
            self._learn(new)
        out = []
        for ws in chunk:
            found = [known[w] for w in ws]
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])))
        return out

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and the decoded text (token strings joined by blanks)."""
        out, chunk, size = [], [], 0
        collecting = gc.isenabled()
        gc.disable()  # nothing below forms cycles, and the remembered words make each collection long
        try:
            for text in texts:
                chunk.append(words(text))
                size += len(text or "")
                if size >= CHUNK:
                    out += self._chunk(chunk)
                    chunk, size = [], 0
            return out + self._chunk(chunk)
        finally:
            if collecting:
                gc.enable()

    def encode(self, text: str | None) -> tuple[bytes, str]:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids and decoded text of every whole text: ``id_col, n_tokens, ids (binary), decoded``.

    ``tokenizer``: file of a BPE tokenizer that every worker can read. Null and empty texts give no ids and an empty text.
    Rows are independent: repeated rows and null ids come back as they are, other columns are not read, an empty table
    gives an empty one. A very long text costs time in proportion to its length.
    """

    def compute(texts):
        made = _encoder(tokenizer).encode_all(texts)
        return [[len(i) // 4 for i, _ in made], [i for i, _ in made], [d for _, d in made]]

    return map_texts(docs, [id_col], text_col, compute, "n_tokens bigint, ids binary, decoded string")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: `encode_documents` with its outputs hashed where they are made."""

    def compute(texts):
        made = _encoder(tokenizer).encode_all(texts)
        return [[len(i) // 4 for i, _ in made], [hashlib.sha256(i).hexdigest() for i, _ in made], [hashlib.sha256(d.encode()).hexdigest() for _, d in made]]

    return map_texts(docs, [id_col], text_col, compute, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
