"""Text folding, keyword counting and snippet extraction as Catalyst Column expressions.

Every function here returns a ``Column``; nothing runs Python per row.  Keywords are plan-time
literals, so everything that depends only on the keyword (its folded forms, its regex, the
one-character guard) is computed once in Python while the plan is built.

Match modes:
  exact    case-sensitive literal, non-overlapping.
  default  max(case-insensitive Unicode literal count, count of the space-folded keyword in the
           space-folded text).  The folded pass is skipped for keywords with ASCII punctuation and
           for keywords whose fold is shorter than two characters.
  fuzzy    count of the strictly folded keyword in the strictly folded text; when that is zero,
           the number of words of the space-folded text within edit distance 1 (keyword <= 4
           chars) or 2 (longer) of the keyword.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("default", "exact", "fuzzy")

# Fixed values that must equal the search tool's: snippet context radius, snippet length cap,
# line-snippet cap and snippets kept per page.
SNIPPET_RADIUS = 60
SNIPPET_CAP = 500
LINE_SNIPPET_CAP = 120
PAGE_SNIPPETS = 3


@functools.lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Translate table for diacritic folding, built by rule from the Unicode database.

    Every non-ASCII code point whose canonical decomposition, with combining marks removed, is a
    single ASCII letter or digit maps to that letter or digit.  All such code points are in the
    BMP and map one-to-one, so ``translate`` with this table is length-preserving — which is what
    lets folded match positions index the original text.
    """
    src, dst = [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.category(c).startswith("M"))
        if len(base) == 1 and ord(base) < 128 and base.isalnum():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


# ----------------------------------------------------------------------------------------------
# Plan-time (Python) versions, applied to literal keywords only.
# ----------------------------------------------------------------------------------------------

def _strip_marks_lower(s: str) -> str:
    nfd = unicodedata.normalize("NFD", s)
    return "".join(c for c in nfd if not unicodedata.category(c).startswith("M")).lower()


def fold_strict_py(s: str | None) -> str:
    if s is None:
        return ""
    return re.sub(r"[^a-z0-9]", "", _strip_marks_lower(s))


def fold_spaces_py(s: str | None) -> str:
    if s is None:
        return ""
    return re.sub(r"[^a-z0-9]+", " ", _strip_marks_lower(s))


def has_ascii_special(keyword: str) -> bool:
    return any(ord(c) < 128 and not c.isalnum() and c != " " for c in keyword)


def java_quote(s: str) -> str:
    """Quote a literal for java.util.regex (Spark's regex engine), like ``Pattern.quote``."""
    if "\\E" not in s:
        return "\\Q" + s + "\\E"
    parts = s.split("\\E")
    return "\\Q" + "\\E\\\\E\\Q".join(parts) + "\\E"


def keyword_regex(keyword: str, mode: str) -> str:
    """Regex used for the literal pass: case-sensitive in exact mode, else Unicode case-insensitive."""
    q = java_quote(keyword)
    return q if mode == "exact" else "(?iu)" + q


def fuzzy_threshold(folded_keyword: str) -> int:
    return 1 if len(folded_keyword) <= 4 else 2


# ----------------------------------------------------------------------------------------------
# Column expressions.
# ----------------------------------------------------------------------------------------------

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


T_col = _col


def _is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def unmark_lower(c) -> Column:
    src, dst = fold_table()
    c = _col(c)
    plain = F.regexp_replace(F.translate(c, src, dst), r"\p{M}", "")
    return F.lower(F.when(_is_ascii(c), c).otherwise(plain))  # ASCII has nothing to fold


def strict(unmarked) -> Column:
    return F.regexp_replace(_col(unmarked), "[^a-z0-9]", "")


def spaced(unmarked) -> Column:
    return F.regexp_replace(_col(unmarked), "[^a-z0-9]+", " ")


def fold_strict(c) -> Column:
    """Diacritics folded, lower-cased, only ``[a-z0-9]`` kept (``Café`` -> ``cafe``)."""
    return strict(unmark_lower(c))


def fold_spaces(c) -> Column:
    """As :func:`fold_strict`, but every run of other characters becomes one space."""
    return spaced(unmark_lower(c))


def count_literal(c, needle: str) -> Column:
    """Non-overlapping, left-to-right occurrences of a literal (0 for null text)."""
    c = _col(c)
    left = F.octet_length(F.replace(c, F.lit(needle), F.lit("")))  # bytes are known without a pass over the text
    found = F.floor((F.octet_length(c) - left) / F.lit(len(needle.encode()))).cast("int")
    return F.when(F.contains(c, F.lit(needle)), found).otherwise(0)


def count_exact(c, keyword: str) -> Column:
    if not keyword:
        return F.lit(0)
    return count_literal(c, keyword)


def count_ci(c, keyword: str) -> Column:
    if not keyword:
        return F.lit(0)
    c = _col(c)
    by_regex = F.coalesce(F.regexp_count(c, F.lit(keyword_regex(keyword, "default"))), F.lit(0))
    if not keyword.isascii():
        return by_regex
    return F.when(_is_ascii(c), count_literal(F.lower(c), keyword.lower())).otherwise(by_regex)


def count_default(c, keyword: str, folded_spaces=None) -> Column:
    if not keyword:
        return F.lit(0)
    ci = count_ci(c, keyword)
    if has_ascii_special(keyword):
        return ci
    sk = fold_spaces_py(keyword).strip()
    if len(sk) < 2:
        return ci
    fs = fold_spaces(c) if folded_spaces is None else T_col(folded_spaces)
    return F.greatest(ci, count_literal(fs, sk))


def fuzzy_word_hits(c, keyword: str, folded_spaces=None) -> Column:
    """Words of the space-folded text within the edit-distance threshold of the folded keyword."""
    sk = fold_strict_py(keyword)
    if len(sk) < 2:
        return F.lit(0)
    t = fuzzy_threshold(sk)
    n = len(sk)
    words = F.split(fold_spaces(c) if folded_spaces is None else T_col(folded_spaces), " ")
    hits = F.filter(
        words,
        lambda w: (w != F.lit(""))
        & (F.abs(F.length(w) - F.lit(n)) <= F.lit(t))
        & (F.levenshtein(w, F.lit(sk), t) >= F.lit(0)),
    )
    return F.coalesce(F.size(hits), F.lit(0))


def count_fuzzy(c, keyword: str, folded_strict=None, folded_spaces=None) -> Column:
    if not keyword:
        return F.lit(0)
    sk = fold_strict_py(keyword)
    if len(sk) < 2:
        return F.lit(0)
    folded = fold_strict(c) if folded_strict is None else T_col(folded_strict)
    sub = F.transform(F.array(count_literal(folded, sk)), lambda n: F.when(n > 0, n).otherwise(fuzzy_word_hits(c, keyword, folded_spaces)))
    return F.element_at(sub, 1)


def count_matches(c, keyword: str, mode: str = "default", folded_strict=None, folded_spaces=None) -> Column:
    """Match count in ``mode``.  ``folded_strict`` / ``folded_spaces`` may name columns that
    already hold the folds of ``c`` (computed once per row when several keywords share them)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "exact":
        return count_exact(c, keyword)
    if mode == "fuzzy":
        return count_fuzzy(c, keyword, folded_strict, folded_spaces)
    return count_default(c, keyword, folded_spaces)


# ----------------------------------------------------------------------------------------------
# Snippets.
# ----------------------------------------------------------------------------------------------

def java_trim(c) -> Column:
    """Strip leading/trailing code points <= U+0020 (Java ``String.trim``)."""
    return F.regexp_replace(_col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def strip_controls(c) -> Column:
    return F.regexp_replace(_col(c), r"[\x00-\x1F\x7F]", "")


def flatten_whitespace(c) -> Column:
    """CR/LF/tab/nbsp runs -> one space, space runs collapsed, trimmed."""
    one = F.regexp_replace(_col(c), r"[\r\n\t\u00A0]+", " ")
    return java_trim(F.regexp_replace(one, " {2,}", " "))


def _locate(sub: str, c: Column, pos: Column) -> Column:
    return F.call_function("locate", F.lit(sub), c, pos)


def build_snippet(flat: Column, rev: Column, n: Column, start: Column, end: Column) -> Column:
    """Context excerpt for the match ``[start, end)`` (0-based) of the flattened text.

    ``rev`` is ``reverse(flat)`` and ``n`` its length; both are passed in so they are computed
    once per row, not once per match.  The window is +-60 characters widened outward to the
    nearest space, with ``...`` where it stops short of an edge, control characters removed and
    the result capped at 500 characters.
    """
    lo0 = F.greatest(start - F.lit(SNIPPET_RADIUS), F.lit(0))
    hi0 = F.least(end + F.lit(SNIPPET_RADIUS), n)
    r = _locate(" ", rev, n - lo0 + F.lit(1))
    lo = F.when((lo0 == 0) | (r == 0), F.lit(0)).otherwise(n - r + F.lit(1))
    h = _locate(" ", flat, hi0 + F.lit(1))
    hi = F.when((hi0 >= n) | (h == 0), n).otherwise(h - F.lit(1))
    body = java_trim(F.substring(flat, lo + F.lit(1), hi - lo))
    snip = strip_controls(
        F.concat(
            F.when(lo > 0, F.lit("...")).otherwise(F.lit("")),
            body,
            F.when(hi < n, F.lit("...")).otherwise(F.lit("")),
        )
    )
    return F.when(F.length(snip) > SNIPPET_CAP, F.concat(F.substring(snip, 1, SNIPPET_CAP - 3), F.lit("..."))).otherwise(
        snip
    )


CHUNK = 256  # code points of the pieces a text is cut into for local context


def _chunks(flat: Column) -> Column:
    return F.regexp_extract_all(flat, F.lit("(?s).{1,%d}" % CHUNK), 0)


def _local_snippet(x: Column, start: Column, end: Column) -> Column:
    """:func:`build_snippet` from the chunks around one match, at a cost that does not depend on the text's length.

    ``x``: struct(flat, n, chunks).  The chunks reach at least ``CHUNK`` characters before the window and twice
    that after it, so what the snippet shows lies inside them, unless the text has no space there on
    the left or has control characters (which do not count towards the cap); then the whole text is used."""
    def window(w):
        lo0, hi0 = F.greatest(w["s"] - F.lit(SNIPPET_RADIUS), F.lit(0)), F.least(w["e"] + F.lit(SNIPPET_RADIUS), w["n"])
        first = F.greatest(F.floor(lo0 / CHUNK).cast("int") - 1, F.lit(0))
        last = F.floor(hi0 / CHUNK).cast("int") + 2
        local = F.array_join(F.slice(w["chunks"], first + 1, last - first + 1), "")
        return F.struct(w["s"].alias("s"), w["e"].alias("e"), w["n"].alias("n"), w["flat"].alias("flat"), local.alias("local"),
                        (first * CHUNK).alias("off"), (lo0 - first * CHUNK).alias("lo0"), (hi0 - first * CHUNK).alias("hi0"))

    def spaces(w):
        r = _locate(" ", F.reverse(F.substring(w["local"], F.lit(1), w["lo0"])), F.lit(1))
        h = _locate(" ", w["local"], w["hi0"] + F.lit(1))
        return F.struct(*[w[f].alias(f) for f in ("s", "e", "n", "flat", "local", "off", "lo0", "hi0")], r.alias("r"), h.alias("h"),
                        F.length(w["local"]).alias("len"))

    def text(w):
        at_start = w["off"] + w["lo0"] == 0
        lo = F.when((w["r"] == 0) | at_start, F.lit(0)).otherwise(w["lo0"] - w["r"] + F.lit(1))
        hi = F.when((w["off"] + w["hi0"] >= w["n"]) | (w["h"] == 0), w["len"]).otherwise(w["h"] - F.lit(1))
        body = java_trim(F.substring(w["local"], lo + F.lit(1), hi - lo))
        snip = F.concat(F.when(w["off"] + lo > 0, F.lit("...")).otherwise(F.lit("")), body,
                        F.when(w["off"] + hi < w["n"], F.lit("...")).otherwise(F.lit("")))
        cut = F.when(F.length(snip) > SNIPPET_CAP, F.concat(F.substring(snip, 1, SNIPPET_CAP - 3), F.lit("..."))).otherwise(snip)
        odd = ((w["r"] == 0) & (w["off"] > 0)) | w["local"].rlike(r"[\x00-\x1F\x7F]")
        return F.when(odd, build_snippet(w["flat"], F.reverse(w["flat"]), w["n"], w["s"], w["e"])).otherwise(cut)

    arr = F.array(F.struct(start.alias("s"), end.alias("e"), x["n"].alias("n"), x["flat"].alias("flat"), x["chunks"].alias("chunks")))
    for stage in (window, spaces, text):
        arr = F.transform(arr, stage)
    return F.element_at(arr, 1)


def _collect_snippets(x: Column, searched: Column, pattern: str, prior: Column, most: int) -> Column:
    """``prior`` and the distinct snippets of the matches of ``pattern`` in ``searched`` (as long as the text), in
    order, up to ``most``: one pass over the matches that carries the position, and stops working when full."""
    pieces = F.transform(F.split(searched, pattern, -1), lambda p: F.length(p))
    lengths = F.transform(F.regexp_extract_all(searched, F.lit(pattern), 0), lambda m: F.length(m))
    hits = F.zip_with(pieces, lengths, lambda gap, m: F.struct(gap.alias("gap"), m.alias("len")))  # the last gap has no match

    def step(acc, h):
        start = acc["pos"] + h["gap"]
        more = F.array_distinct(F.concat(acc["out"], F.array(_local_snippet(x, start, start + h["len"]))))
        return F.struct((start + h["len"]).alias("pos"), F.when((F.size(acc["out"]) >= most) | h["len"].isNull(), acc["out"]).otherwise(more).alias("out"))

    return F.aggregate(hits, F.struct(F.lit(0).alias("pos"), prior.alias("out")), step, lambda acc: acc["out"])


def literal_starts(flat: Column, keyword: str) -> Column:
    """0-based starts of all matches of a literal, for callers that explode them."""
    lengths = F.transform(F.split(flat, java_quote(keyword), -1), lambda p: F.length(p))
    gaps = F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0)))
    grown = F.aggregate(gaps, F.array().cast("array<int>"),
                        lambda acc, g: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(keyword), F.lit(0)) + g)))
    return grown


def literal_snippets(flat: Column, keyword: str) -> Column:
    """:func:`build_snippet` of every match of a literal, each from the text around it: the text is cut into chunks once."""
    x = F.struct(flat.alias("flat"), F.length(flat).alias("n"), _chunks(flat).alias("chunks"), literal_starts(flat, keyword).alias("starts"))
    found = F.transform(F.array(x), lambda x: F.transform(x["starts"], lambda s: _local_snippet(x, s, s + len(keyword))))
    return F.element_at(found, 1)


def _folded_pattern(keyword: str, mode: str) -> str | None:
    if mode == "exact":
        return None
    if mode == "default":
        if has_ascii_special(keyword):
            return None
        sk = fold_spaces_py(keyword).strip()
        gap = "[^a-z0-9 ]*"
    else:
        sk = fold_strict_py(keyword)
        gap = "[^a-z0-9]*"
    if len(sk) < 2:
        return None
    return gap.join(re.escape(ch) if ch != " " else " " for ch in sk)


def find_snippets(c, keyword: str, mode: str = "default", max_snippets: int = PAGE_SNIPPETS) -> Column:
    """Up to ``max_snippets`` distinct context excerpts, literal-pass hits first, then folded hits.

    The folded pass runs a regex on ``lower(translate(flat))`` whose keyword characters are
    joined by a class of skipped characters; since the fold is length-preserving its match span
    is the span in the original text, so excerpts show the original accented characters.  It runs
    only when the literal pass has not filled the list.

    Each pass goes once over its matches and takes an excerpt from the chunks around a match, so the cost
    grows with the text and not with its square.  The work runs as ``transform`` stages over one-element
    arrays of context structs: the flattened text, its chunks and its fold are computed once per row.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    none = F.array().cast("array<string>")
    if not keyword:
        return none
    src, dst = fold_table()
    lit_pat = keyword_regex(keyword, "exact" if mode == "exact" else "default")
    fold_pat = _folded_pattern(keyword, mode)

    def context(x):
        return F.struct(x["flat"].alias("flat"), F.length(x["flat"]).alias("n"), _chunks(x["flat"]).alias("chunks"))

    def literal(x):
        found = _collect_snippets(x, x["flat"], lit_pat, none, max_snippets)
        return F.struct(*[x[f].alias(f) for f in ("flat", "n", "chunks")], found.alias("lit"))

    def folded(x):
        def fold(y):
            return F.struct(*[y[f].alias(f) for f in ("flat", "n", "chunks", "lit")],
                            F.lower(F.translate(y["flat"], src, dst)).alias("folded"))

        arr = F.transform(F.array(x), fold)
        return F.element_at(F.transform(arr, lambda y: _collect_snippets(y, y["folded"], fold_pat, y["lit"], max_snippets)), 1)

    def both(x):
        out = F.when(F.size(x["lit"]) >= max_snippets, x["lit"]).otherwise(folded(x)) if fold_pat else x["lit"]
        return F.when(x["flat"].isNull() | (x["n"] == 0), none).otherwise(out)

    arr = F.array(F.struct(flatten_whitespace(c).alias("flat")))
    for stage in (context, literal, both):
        arr = F.transform(arr, stage)
    return F.element_at(arr, 1)


def line_snippet(c) -> Column:
    """Trimmed line, control characters removed, over 120 chars cut to 117 + ``...``."""
    s = strip_controls(java_trim(c))
    return F.when(F.length(s) > LINE_SNIPPET_CAP, F.concat(F.substring(s, 1, LINE_SNIPPET_CAP - 3), F.lit("..."))).otherwise(
        s
    )


def format_duration(ms) -> Column:
    """``4.23s`` under a minute, else ``1m 32.00s``."""
    ms = _col(ms)
    return F.when(ms < 60000, F.format_string("%.2fs", ms / F.lit(1000.0))).otherwise(
        F.format_string("%dm %.2fs", F.floor(ms / 60000).cast("long"), (ms % 60000) / F.lit(1000.0))
    )
