"""Occurrences of many keywords in many lines at once, as array operations over the bytes of a batch.

Spark has no function that searches a text for a table of literals, and a join of lines and keywords costs a
pass over the line for every pair that may match.  Here the eight bytes from every position of a batch are one
number, and the keywords of one length are looked up by that number; longer ones by their first and last eight
bytes.  Memory is bounded by blocks of positions and by what is found, not by the length of a line or the table times the lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CODE = 8  # bytes of a number
BLOCK = 1 << 18  # positions that are looked up at a time
_BITS = 33  # of a packed count: what is found in a block fits into 32, and one says where from
_MIX, _MIX_TAIL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _codes(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` positions as one number, zeros beyond the end."""
    c = np.zeros(n + CODE - 1, np.uint64)
    c[: len(data)] = data[: len(c)]
    for width in (1, 2, 4):
        c = (c[:-width] << np.uint64(8 * width)) | c[width:]
    return c


def _code_of(x: bytes) -> int:
    return int.from_bytes(x, "big")


class _Numbers:
    """The places of 64-bit numbers in a list.  A number's slot in a table names one number of the list, so that most are met or ruled
    out by one look; those that share a slot are searched for."""

    def __init__(self, numbers: np.ndarray):
        self.order = np.argsort(numbers, kind="stable")
        self.sorted, self.first, self.sizes = np.unique(numbers[self.order], return_index=True, return_counts=True)
        self.bits = max(12, (8 * len(self.sorted)).bit_length())
        slots = self._slot(self.sorted)
        self.named = np.zeros(1 << self.bits, np.int32)  # 0: none
        self.named[slots] = np.arange(1, len(slots) + 1)
        self.shared = np.bincount(slots, minlength=1 << self.bits) > 1

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * _MIX) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``numbers``, place in the list) of all that are equal."""
        slots = self._slot(numbers)
        named = self.named[slots]
        at = np.flatnonzero(named != 0)
        place, wanted = named[at] - 1, numbers[at]
        same = self.sorted[place] == wanted
        other = np.flatnonzero(~same & self.shared[slots[at]])
        if len(other):
            place[other] = np.minimum(np.searchsorted(self.sorted, wanted[other]), len(self.sorted) - 1)
            same[other] = self.sorted[place[other]] == wanted[other]
        at, place = at[same], place[same]
        if len(self.sorted) == len(self.order):
            return at, self.order[place]
        which, place = expand(self.first[place], self.sizes[place])
        return at[which], self.order[place]


def _summed(keys: Sequence[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key // width, key % width, how often) of the distinct keys."""
    key = np.sort(np.concatenate([np.zeros(0, np.int64), *keys]))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times, key = np.diff(np.append(first, len(key))), key[first]
    line = key // width
    return line, key - line * width, times


def expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, start[i] + j) for every j below size[i]."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) + np.repeat(start - (np.cumsum(size) - size), size)


class Literals:
    """Distinct byte strings, counted in lines as ``bytes.count`` does: from left to right, without overlap."""

    def __init__(self, literals: Sequence[bytes]):
        self.literals = list(literals)
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(self.literals):
            by_length.setdefault(len(x), []).append(i)
        self.short, self.long = [], []
        for n, some in sorted(by_length.items()):
            number = np.array(some)
            head = np.array([_code_of(self.literals[i][:CODE]) for i in some], np.uint64)
            if n <= CODE:
                self.short.append((n, number, _Numbers(head)))
            else:
                tail = np.array([_code_of(self.literals[i][-CODE:]) for i in some], np.uint64)
                self.long.append((n, number, head, tail, _Numbers(head * _MIX ^ tail * _MIX_TAIL)))
        self.heads = _Numbers(np.unique(np.concatenate([x[2] for x in self.long]))) if self.long else None
        # From so many found places on, their number is not the count: they can overlap, or hold more than the two numbers.
        borders = [any(x.startswith(x[j:]) for j in range(1, len(x))) for x in self.literals]
        self.from_times = np.array([1 if len(x) > 2 * CODE else 2 if b else 1 << 62 for x, b in zip(self.literals, borders, strict=True)], np.int64)

    def _places(self, data: np.ndarray, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(positions, literals, their length) that start in a block; an occurrence may run over the end of its line."""
        code = _codes(data[begin : end + CODE], end - begin)
        for n, number, numbers in self.short:
            cut = code >> np.uint64(8 * (CODE - n)) if n < CODE else code
            at, place = numbers.find(cut)
            yield at + begin, number[place], n
        if self.heads is None:
            return
        at = self.heads.find(code)[0]
        head, at = code[at], at + begin
        windows = np.lib.stride_tricks.sliding_window_view(data, CODE) if len(data) >= CODE else None
        for n, number, heads, tails, numbers in self.long:
            inside = at + n <= len(data)
            at, head = at[inside], head[inside]  # lengths ascend
            if not len(at):
                return
            tail = windows[at + n - CODE].copy().view(">u8").ravel().astype(np.uint64)
            which, place = numbers.find(head * _MIX ^ tail * _MIX_TAIL)
            same = (heads[place] == head[which]) & (tails[place] == tail[which])
            yield at[which[same]], number[place[same]], n

    def counts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, literal, count) of what is found; line i is ``data[starts[i]:starts[i + 1]]``."""
        lines, width, keys = len(starts) - 1, len(self.literals), []
        for begin in range(0, len(data), BLOCK):
            end = min(begin + BLOCK, len(data))
            line_of = np.repeat(np.arange(lines), np.diff(np.clip(starts, begin, end)))
            for at, literal, n in self._places(data, begin, end):
                line = line_of[at - begin]
                whole = at + n <= starts[line + 1]
                keys.append(line[whole] * width + literal[whole])
        line, literal, n = _summed(keys, width)
        again = np.flatnonzero(n >= self.from_times[literal])
        if len(again):
            text = data.tobytes()
            for i, j, a, b in zip(again.tolist(), literal[again].tolist(), starts[line[again]].tolist(), starts[line[again] + 1].tolist(), strict=True):
                n[i] = text.count(self.literals[j], a, b)
        held = n > 0
        return line[held], literal[held], n[held]


class NearWords:
    """Words and the keywords (columns from 0 to ``width`` - 1) that each is near to."""

    def __init__(self, words: Sequence[bytes], sizes: np.ndarray, columns: np.ndarray, width: int):
        """``columns`` are those of the first word, then of the second, and so on, as many as ``sizes`` says."""
        self.width, self.columns, self.sizes = width, columns.astype(np.int32), sizes.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.length = np.array([len(x) for x in words], np.int64)
        short = np.flatnonzero(self.length <= 2 * CODE)
        self.short = short
        self.head = np.array([_code_of(words[i][:CODE].ljust(CODE, b"\0")) for i in short], np.uint64)
        self.tail = np.array([_code_of(words[i][CODE:].ljust(CODE, b"\0")) for i in short], np.uint64)
        self.numbers = _Numbers(self.head * _MIX ^ self.tail * _MIX_TAIL)
        self.long = {words[i]: i for i in np.flatnonzero(self.length > 2 * CODE)}

    def counts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, keyword, count) of the words of a line, as spaces part them, that are near to a keyword."""
        least, most = (self.length.min(), self.length.max()) if len(self.length) else (1, 0)
        line_begin, line_end = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        filled = np.diff(starts) > 0
        line_begin[starts[:-1][filled]] = line_end[starts[1:][filled]] = True
        letter = data != ord(" ")
        begin = np.flatnonzero(letter & (line_begin[:-1] | ~np.append(False, letter[:-1])))
        end = np.flatnonzero(letter & (line_end[1:] | ~np.append(letter[1:], False))) + 1
        size = end - begin
        like = (size >= least) & (size <= most)
        begin, size, keys = begin[like], size[like], []
        for block in range(0, len(begin), BLOCK):
            b = begin[block : block + BLOCK]
            at, word = self._find(data, b, size[block : block + BLOCK])
            which, column = expand(self.first[word], self.sizes[word])
            line = np.searchsorted(starts, b[at], "right") - 1
            keys.append(line[which] * self.width + self.columns[column])
        return _summed(keys, self.width)

    def _find(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``begin``, word)"""
        short = np.flatnonzero(size <= 2 * CODE)
        padded = np.append(data, np.zeros(2 * CODE, np.uint8))
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * CODE)
        both = windows[begin[short]]  # a copy
        both[np.arange(2 * CODE) >= size[short, None]] = 0
        head, tail = (both[:, k : k + CODE].copy().view(">u8").ravel().astype(np.uint64) for k in (0, CODE))
        numbers = head * _MIX ^ tail * _MIX_TAIL
        which, place = self.numbers.find(numbers)
        same = (self.head[place] == head[which]) & (self.tail[place] == tail[which])
        found = [(short[which[same]], self.short[place[same]])]
        if self.long:
            text = data.tobytes()
            some = [(i, self.long.get(text[begin[i] : begin[i] + size[i]])) for i in np.flatnonzero(size > 2 * CODE)]
            pairs = np.array([x for x in some if x[1] is not None], np.int64).reshape(-1, 2)
            found.append((pairs[:, 0], pairs[:, 1]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Columns:
    """Columns of a keyword table that look for literals in one form of a line."""

    def __init__(self, columns: Sequence[int], literals: Sequence[bytes]):
        distinct = sorted(set(literals))
        number = {x: i for i, x in enumerate(distinct)}
        literal = np.array([number[x] for x in literals], np.int64)
        self.columns = np.array(columns, np.int64)[np.argsort(literal, kind="stable")]
        self.sizes = np.bincount(literal, minlength=len(distinct))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.search = Literals(distinct)

    def counts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, column, count) of what is found."""
        line, literal, n = self.search.counts(data, starts)
        which, at = expand(self.first[literal], self.sizes[literal])
        return line[which], self.columns[at], n[which]


class KeywordScan:
    """A keyword table as it is sent to tasks.  ``keywords``: (number, mode, keyword, case-folded, spaced or None if the fold
    does not count, strict), the texts as bytes; ``near``: words, how many keywords each is near to, and their numbers."""

    def __init__(self, keywords: Sequence[tuple], near: tuple | None = None):
        self.numbers = np.array([k[0] for k in keywords], np.int64)
        modes = [k[1] for k in keywords]

        def columns(mode, field):
            some = [i for i, m in enumerate(modes) if m == mode and keywords[i][field] is not None]
            return _Columns(some, [keywords[i][field] for i in some]) if some else None

        self.forms = [columns("exact", 2), columns("default", 3), columns("default", 4), columns("fuzzy", 5)]
        self.near = None
        if near is not None:
            words, sizes, numbers = near
            order = np.argsort(self.numbers)
            self.near = NearWords(words, sizes, order[np.searchsorted(self.numbers[order], numbers)], len(keywords))

    def _counts(self, texts: Sequence[tuple[np.ndarray, np.ndarray]], a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line - a, column, count) of lines from ``a`` to ``b``; near words as negative numbers, where the line does not hold the
        keyword."""
        width, packed = len(self.numbers), [np.zeros(0, np.int64)]
        for form, (data, starts) in zip([*self.forms, self.near], [*texts, texts[2]], strict=True):
            if form is not None:
                line, column, n = form.counts(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                packed.append((line * width + column) << _BITS | (form is not self.near) << _BITS - 1 | n)
        found = np.sort(np.concatenate(packed))
        key = found >> _BITS
        found, key = (x[np.append(key[1:] != key[:-1], True)[: len(key)]] for x in (found, key))  # of the two forms of a default keyword the larger
        line, n = key // width, found & (1 << _BITS - 1) - 1
        return line, key - line * width, np.where(found >> _BITS - 1 & 1, n, -n)

    def hits(self, texts: Sequence[tuple[np.ndarray, np.ndarray]], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hits per line, keyword numbers, counts) of lines in four forms (as they are, case-folded, spaced, strict), each as
        (data, starts).  A line that comes ``times`` is as many matches of a keyword it holds, and one of near words."""
        lines, step = len(times), max(1, (1 << 62 - _BITS) // max(1, len(self.numbers)))
        per_line, numbers, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        a = 0
        while a < lines:
            b = max(a + 1, min([a + step, lines, *(int(np.searchsorted(starts, starts[a] + BLOCK, "right")) - 1 for _, starts in texts)]))
            line, column, n = self._counts(texts, a, b)
            again = times[a:b][line]
            if (again > 1).any():
                copies = np.where(n > 0, again, 1)
                line, column, n = (np.repeat(x, copies) for x in (line, column, np.where(n > 0, n, n * again)))
            per_line.append(np.bincount(line, minlength=b - a))
            numbers.append(self.numbers[column])
            counts.append(np.abs(n))
            a = b
        return np.concatenate(per_line), np.concatenate(numbers), np.concatenate(counts)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(data, starts) of an Arrow array of binaries without nulls."""
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), starts


HITS = "array<struct<_kid:bigint,count:int>>"


def scanner(sent):
    """The function of an Arrow UDF: the hits (``HITS``) of the lines of a batch, from a broadcast ``KeywordScan``."""

    def scan(line, cased, spaced, strict, times):
        import pyarrow as pa

        sizes, numbers, counts = sent.value.hits([bytes_of(x) for x in (line, cased, spaced, strict)], times.to_numpy(zero_copy_only=False))
        found = pa.StructArray.from_arrays([pa.array(numbers, pa.int64()), pa.array(counts.astype(np.int32), pa.int32())], names=["_kid", "count"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found)

    return scan
