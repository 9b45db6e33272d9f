"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities."""
from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalframe.llm.forced_bpe import byte_chars
from modalframe.llm.text import map_texts
from modalframe.session import scratch_path

#: Fragments whose ids a worker remembers in each of two generations: a full one becomes the old one, and fragments met again move
#: on to the new one. Bounds its memory, not the result.
REMEMBERED = 150_000
#: Characters of text whose fragments are looked up, and the unknown ones encoded, together.
CHUNK = 1 << 18
#: Pieces packed together. Groups grow in number with the input, never in size.
PIECES_PER_GROUP = 4096

# Cuts that no token crosses: before a blank that begins a word, around other white space, and between letters or digits and
# punctuation. Runs with an apostrophe or with characters beyond Latin stay whole up to the next white space.
_LETTERS, _MARKS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"!-&(-/:-@\[-`{-~"
_ALNUM = f"0-9{_LETTERS}"
_FRAGMENT = re.compile(rf" ?[{_ALNUM}]++(?=[{_MARKS} \t-\r]|\Z)| ?[{_MARKS}]++(?=[{_ALNUM} \t-\r]|\Z)| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_ODD_BLANK = re.compile(r"[^\S \t-\r]")  # white space beyond ASCII, or that not every regex engine takes as such
_WORD = re.compile(rf" ?[{_LETTERS}]+")  # one pre-token of the byte-level pattern
_TO_BYTE_CHAR = byte_chars()


class FragmentEncoder:
    """Byte-level BPE by fragments that no token crosses; each distinct fragment is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        level = self.whole.pre_tokenizer
        #: Whether a word is one pre-token whose merges the model can make by itself, without the steps around it.
        self.bare = self.whole.normalizer is None and isinstance(level, ByteLevel) and level.use_regex and not level.add_prefix_space
        self.model = self.whole.model
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, held, size = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special) or _ODD_BLANK.search(text):
                out[k] = self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
                continue
            held.append((k, _FRAGMENT.findall(text)))
            size += len(text)
            if size >= CHUNK:
                self._place(held, out)
                held, size = [], 0
        self._place(held, out)
        return out

    def _place(self, held: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        """Put the ids of each text, given as its place and fragments, into ``out``."""
        self._learn(set().union(*[pieces for _, pieces in held]))
        known = self.cache.__getitem__
        for k, pieces in held:
            out[k] = b"".join(map(known, pieces))

    def _learn(self, pieces: set[str]) -> None:
        if len(self.cache) > REMEMBERED:
            self.cache, self.older = {}, self.cache
        cache, older, odd = self.cache, self.older, []
        for p in pieces.difference(cache):
            if p in older:
                cache[p] = older[p]
            elif self.bare and _WORD.fullmatch(p):
                shown = p.replace(" ", "\u0120") if p.isascii() else p.encode().decode("latin-1").translate(_TO_BYTE_CHAR)
                cache[p] = self._bytes([t.id for t in self.model.tokenize(shown)])
            else:
                odd.append(p)
        for p, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            cache[p] = self._bytes(e.ids)


@lru_cache(maxsize=2)
def _encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for a shorter first."""
    first = n % capacity if n > capacity else n
    starts = [(0, first)] if first else []
    return starts + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document's ids (its tokens, then ``end_id``): ``id_col, piece, start, length, ids_crc32``."""
    end = end_id.to_bytes(4, "little")

    def compute(texts):
        made = []
        for ids in _encoder(tokenizer).encode_all(texts):
            ids += end
            made.append([{"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(ids[4 * s : 4 * (s + n)])} for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))])
        return [made]

    rows = map_texts(docs, [id_col], text_col, compute, "p array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    return rows.select(id_col, F.inline("p"))


class OpenBins:
    """Open bins by remaining capacity; a segment tree over the capacities finds the tightest that still fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)  # how many open bins lie below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.open[node] += by
            node >>= 1

    def put(self, bin_no: int, room: int) -> None:
        self.bins[room].append(bin_no)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the fullest bin with at least ``need`` room: (bin, room), or None."""
        node = need + self.size
        if not self.open[node]:
            while node > 1 and (node & 1 or not self.open[node + 1]):  # up, until a branch to the right has a bin
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; ``lengths`` must fall. Each item goes to the tightest open bin, else to a new one."""
    bins, offsets, tree, opened = [], [], OpenBins(capacity), 0
    for n in lengths:
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} is not within 1 to {capacity}")
        found = tree.tightest(n)
        if found is None:
            found, opened = (opened, capacity), opened + 1
        bins.append(found[0])
        offsets.append(capacity - found[1])
        if found[1] > n:
            tree.put(found[0], found[1] - n)
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int, group_size: int = PIECES_PER_GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (``length`` from 1 to ``capacity``).

    Pieces are dealt by hash into groups of about ``group_size`` and packed group by group, so no task grows with the
    input; next to one global packing this opens at most a few more bins a group. The place of a row is hashed along, so equal
    rows are dealt out like all others. ``pieces`` must be a stored table: it is read twice, and its rows have fixed places.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_size))
    names = pieces.columns
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id()), F.lit(groups)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", *names], ascending=[False, *[True] * len(names)], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(frame["length"].tolist(), capacity)
        frame["sequence_id"] = [b + (int(frame["pack_group"].iloc[0]) << 36) for b in bins]
        frame["offset"] = offsets
        return frame[[*names, "sequence_id", "offset"]]

    schema = dealt.select(*names, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema
    return dealt.groupBy("pack_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Only documents of more than ``capacity`` ids are cut; their first piece may be shorter. A null or empty text is its end
    id alone. Repeated rows are packed once for each row, equal lengths are ordered by the other columns, an empty table
    gives an empty one and other columns are not read. The pieces (a few numbers each) are written to the shared scratch
    folder, so texts are encoded once and a lost executor costs only its own tasks.
    """
    path = scratch_path(docs.sparkSession, "pieces")
    token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col).write.parquet(path)
    return pack_pieces(docs.sparkSession.read.parquet(path), capacity)
