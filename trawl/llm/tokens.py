"""Token counts with a whole-token shortcut.

A byte-level BPE cuts a text into pre-tokens and merges bytes inside each of them.  Which
vocabulary strings come out as exactly one token is proved once, by encoding every one of them with
the model itself; a pre-token on that list counts as one without merging.  Only the others are
merged, and their counts are kept in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import fresh, ship

CACHE = 500_000  # merged pre-tokens remembered by a worker; the table starts anew when full
#: The pre-token pattern of byte-level BPE files with ``use_regex`` (fixed value of the file format).
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for
    themselves, the rest from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class PreTokenCounts(dict):
    """Pre-token to number of tokens.  Holds the proven whole tokens; others are merged when first met."""

    def __init__(self, model, whole: dict[str, int]):
        super().__init__(whole)
        self.model, self.whole = model, whole
        self.symbol = {i: s for i, s in enumerate(byte_symbols())}

    def __missing__(self, pre_token: str) -> int:
        if len(self) > len(self.whole) + CACHE:
            self.clear()
            self.update(self.whole)
        n = len(self.model.tokenize("".join(map(self.symbol.__getitem__, pre_token.encode("utf-8", "replace")))))
        if len(pre_token) <= 64:
            self[pre_token] = n
        return n


def whole_tokens(tokenizer) -> dict[str, int]:
    """Vocabulary strings that are text and that the model leaves as one token, each with count 1."""
    back = {s: i for i, s in enumerate(byte_symbols())}
    out = {}
    for symbols in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in symbols).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(tokenizer.model.tokenize(symbols)) == 1:
            out[text] = 1
    return out


class TokenCounter:
    """Counts the tokens of texts as the ``tokenizers`` library would for the byte-level BPE file ``path``:
    the strings of added tokens inside a text are one token each, and no token is added."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))).split if self.added else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.counts = PreTokenCounts(tokenizer.model, whole_tokens(tokenizer))

    def count(self, text: str) -> int:
        parts = self.split(text) if self.split and any(a in text for a in self.added) else [text]
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.find(p))) for p in parts)


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    A null text counts as empty: 0 bytes, 0 tokens.  Whole texts are counted, however long.  Repeated
    rows each get their row, an empty table gives an empty table, other columns are not read.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(tokenizer_path)
        for texts in batches:
            yield pd.Series([c.count(t) if t else 0 for t in texts], dtype="int64")

    text = F.col(text_col).cast("string")
    n = fresh(docs, "_n")
    counted = docs.select(
        F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens.asNondeterministic()(text).alias(n),
    )
    return counted.select(id_col, "n_bytes", F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))
