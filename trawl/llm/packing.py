"""Packing documents into fixed-length token sequences: shortest-pack-first over the length histogram.

The driver sees only the histogram of piece lengths.  Lengths are placed longest first, each into
the packs that are shortest so far, as patterns with counts rather than as packs.  A pattern takes
a run of ranks of every length it holds, so a piece finds its sequence and offset from its rank
among all pieces of its length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import cut, global_index, ship
from trawl.llm.tokens import byte_symbols

LENGTH = 4096
END_ID = 2
CACHE = 200_000  # words, and pre-tokens, whose ids a worker remembers; the table starts anew when full
#: Python splits at these, the tokenizers library does not.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


class TokenIds(dict):
    """Pre-token (lower case) to the bytes of its ids (little-endian unsigned 32 bit), merged when first met."""

    def __init__(self, model):
        super().__init__()
        self.merge, self.symbols = model.tokenize, byte_symbols()

    def __missing__(self, token: str) -> bytes:
        ids = array("I", [t.id for t in self.merge("".join([self.symbols[b] for b in token.encode()]))])
        if len(self) >= CACHE:
            self.clear()
        found = _little(ids)
        if len(token) <= 48:
            self[token] = found
        return found


class WordIds(dict):
    """Word to the bytes of its ids.  Latin-1 words, which normalising leaves as they are but for case, are cut into
    pre-tokens here; others go through the library whole."""

    def __init__(self, tokenizer, pattern: str):
        super().__init__()
        self.tokenizer, self.pre_tokens, self.tokens = tokenizer, regex.compile(pattern).findall, TokenIds(tokenizer.model)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        return _little(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids))

    def _cut(self, word: str) -> bytes:
        if not word.isascii():
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return self.encode(word)
        low = word.lower()
        if low.isalpha():
            return self.tokens[low]
        if low[-1] in ".," and low[:-1].isalpha():
            return self.tokens[low[:-1]] + self.tokens[low[-1]]
        if any(a in word for a in self.added):
            return self.encode(word)
        return b"".join(map(self.tokens.__getitem__, self.pre_tokens(low)))

    def __missing__(self, word: str) -> bytes:
        ids = self._cut(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 48:
            self[word] = ids
        return ids


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class Encoder:
    """Ids of whole texts for a vocabulary that drops white space, so that words can be encoded one by one."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next((s for s in spec["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"), {})
        pattern = split.get("pattern", {}).get("Regex", "")
        names = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if split.get("behavior") != "Removed" or not split.get("invert") or r"[^\s" not in pattern or names != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a lower-case vocabulary that drops white space is needed")
        self.words = WordIds(Tokenizer.from_file(path), pattern)

    def ids(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACE):
            return self.words.encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and ``end_id``, cut every ``length``."""
    ship(docs.sparkSession)
    fields = "start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    tail = np.array([end_id], dtype="<u4").tobytes()

    @F.pandas_udf(f"struct<n long, p array<struct<{fields}>>>".replace(" long", ":long").replace(" array", ":array"))
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for texts in batches:
            totals, parts = [], []
            for t in texts:
                data = (enc.ids(t) if t else b"") + tail
                totals.append(len(data) // 4)
                row = []
                for at in range(0, len(data), 4 * length):
                    b = data[at : at + 4 * length]
                    one = {"start": at // 4, "length": len(b) // 4, "ids_crc32": zlib.crc32(b)}
                    if with_ids:
                        one["ids"] = np.frombuffer(b, dtype="<u4").astype(np.int64)
                    row.append(one)
                parts.append(row)
            yield pd.DataFrame({"n": totals, "p": parts})

    made = docs.select(F.col(id_col).alias("doc_id"), cut_up.asNondeterministic()(F.col(text_col).cast("string")).alias("t"))
    return made.select("doc_id", F.col("t.n").alias("doc_tokens"), F.inline("t.p"))


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence, longest first; how many sequences have it).  A length goes to the shortest
    packs it fits into; if it fits none, new packs take as many of it as they hold."""
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            room = max((r for r, packs in by_room.items() if packs and r >= size), default=None)
            if room is None:
                whole, rest = divmod(n, length // size)
                if whole:
                    by_room[length - size * (length // size)].append(([size] * (length // size), whole))
                if rest:
                    by_room[length - size * rest].append(([size] * rest, 1))
                n = 0
                continue
            pattern, count = by_room[room].pop()
            used = min(count, n)
            if used < count:
                by_room[room].append((pattern, count - used))
            by_room[room - size].append(([*pattern, size], used))
            n -= used
    return [p for room in sorted(by_room) for p in by_room[room]]


def places(patterns: list[tuple[list[int], int]], histogram: dict[int, int]) -> np.ndarray:
    """Rows (first place, first sequence, offset): the pieces in order of falling length, from one first place to the next,
    take one sequence each from the first sequence on, at the offset."""
    base, at = {}, 0
    for size in sorted(histogram, reverse=True):
        base[size] = at
        at += histogram[size]
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows.append((base[size], sequence, offset))
            base[size] += count
            offset += size
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)


def pack(cut_pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut_pieces`` (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset."""
    sizes = {int(r["length"]): int(r["count"]) for r in cut_pieces.groupBy("length").count().collect()}  # at most ``length`` rows
    table = places(pack_histogram(sizes, length), sizes)

    @F.pandas_udf("struct<sequence_id:long, offset:long>")
    def find(place: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(table[:, 0], place.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[k, 1] + place.to_numpy() - table[k, 0], "offset": table[k, 2]})

    falling = cut_pieces.withColumn("_falling", -F.col("length"))
    ranked, _ = global_index(falling, ["_falling", "doc_id", "start", "ids_crc32"], "_place")
    return ranked.withColumn("_found", find.asNondeterministic()("_place")).select(
        *cut_pieces.columns, "_found.sequence_id", "_found.offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32 (of the ids as little-endian unsigned 32 bit), doc_tokens,
    sequence_id and offset.  A document's ids and ``end_id`` are cut every ``length``; the pieces of a
    sequence lie one behind the other from offset 0.

    A null text is an empty one: its only id is ``end_id``.  Rows repeated under one id are packed each
    for itself.  An empty table gives no pieces.  Other columns, whatever their names, are not read.
    """
    made = cut(pieces(docs, tokenizer_path, length, end_id, id_col, text_col))
    return pack(made, length).withColumnRenamed("doc_id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID,
              pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids): the sequences themselves, padded to ``length`` with ``pad_id`` unless as long as a power of
    two.  Ids of ``docs`` must be unique.  A group here is one sequence, so at most ``length`` ids."""
    ids = pieces(docs, tokenizer_path, length, end_id, id_col, text_col, with_ids=True).select("doc_id", "start", "ids")
    where = packed.select(F.col(id_col).alias("doc_id"), "start", "sequence_id", "offset")
    rows = ids.join(where, ["doc_id", "start"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    flat = rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), F.lit(length) - n))
    return flat.select("sequence_id", F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(padded).alias("ids"))
