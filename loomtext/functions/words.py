"""Words of whole columns of text, from their bytes: the same as those of functions.text, for batches in Python."""

from __future__ import annotations

import zlib
from functools import lru_cache

from pyspark.sql import SparkSession

#: What a character can be: part of a word, what a cut before an upper-case letter follows, upper-case, lower-case.
WORD, BEFORE, UPPER, LOWER = 1, 2, 4, 8
#: What \s means with (?U).
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Capital letters of Unicode 16, which Spark knows and Python 3.13 doesn't, as they are in lower case.
LATER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)}
#: Letters whose lower case Arrow doesn't give: it depends on others, has two characters, or is of late versions of Unicode.
ODD = "[\u0130\u03a3" + "".join(map(chr, LATER)) + "]"
_known: list[bytes] = []


def characters(spark: SparkSession) -> bytes:
    """What each code point is, as Java's patterns of functions.text see it: a byte for each, packed."""
    if not _known:
        import numpy as np

        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        flags = np.zeros(0x110000, dtype="uint8")
        for flag, kind in ((WORD, r"[^\p{IsAlphabetic}\p{N}]+"), (BEFORE, r"[^\p{IsLowercase}\p{N}]+"), (UPPER, r"\P{IsUppercase}+"), (LOWER, r"\P{IsLowercase}+")):
            left = spark._jvm.java.util.regex.Pattern.compile(kind).matcher(every).replaceAll("")
            flags[np.frombuffer(left.encode("utf-32-le"), dtype="uint32")] |= flag
        _known.append(zlib.compress(flags.tobytes()))
    return _known[0]


@lru_cache(maxsize=1)
def _flags(packed: bytes):
    import numpy as np

    return np.frombuffer(zlib.decompress(packed), dtype="uint8")


def raw(column):
    """Bytes of a column of strings, and where rows start (for 0 to the number of rows)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.string()), "")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype="int32", count=column.offset + len(column) + 1)[column.offset :].astype("int64") if len(column) else np.zeros(1, dtype="int64")
    data = np.frombuffer(data, dtype="uint8")[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype="uint8")
    return data, ends - ends[0]


def _edges(data, rows):
    """For each byte, and the end, whether a row starts there."""
    import numpy as np

    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[rows] = edge[-1] = True
    return edge


def _spans(inside, start, edge):
    """Starts and ends of words: bytes inside, cut before each byte of start and at the edges of rows."""
    import numpy as np

    first = inside & start
    first[:1] = inside[:1]
    first[1:] |= inside[1:] & (~inside[:-1] | edge[1:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _column(data, starts, ends):
    """A column of these pieces of the bytes; they don't overlap."""
    import numpy as np
    import pyarrow as pa

    turn = np.zeros(len(data) + 1, dtype="int8")
    turn[starts] += 1
    turn[ends] -= 1
    offsets = np.zeros(len(starts) + 1, dtype="int32")
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[np.cumsum(turn[:-1], dtype="int8").astype(bool)])))


def _row_of(rows, starts):
    import numpy as np

    return np.searchsorted(rows, starts, "right") - 1


def _low(data):
    """Bytes with A-Z as a-z."""
    import numpy as np

    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _lowered(words, wide):
    """words with those that are wide (not ASCII) in lower case."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not wide.any():
        return words
    some = words.filter(pa.array(wide))
    low, odd = pc.utf8_lower(some), pc.match_substring_regex(some, ODD)
    if pc.any(odd).as_py():
        low = pc.replace_with_mask(low, odd, pa.array([w.translate(LATER).lower() for w in some.filter(odd).to_pylist()], pa.string()))
    return pc.replace_with_mask(words, pa.array(wide), low)


def terms(column, packed: bytes):
    """Rows and words of text.terms. packed: of characters(). Letters above U+FFFF are letters like others; a cut of Java's before one that is upper-case takes half of it."""
    import numpy as np

    data, rows = raw(column)
    n, edge = len(data), _edges(data, rows)
    padded = np.concatenate([data, np.zeros(4, dtype="uint8")])
    table = _flags(packed)
    kind = np.concatenate([table[:128], np.zeros(128, dtype="uint8")])[padded]
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0).astype("int64") + (data[lead] >= 0xF0)
    if len(lead):
        b, *more = (padded[lead + k].astype("int64") & (0xFF if k == 0 else 63) for k in range(4))
        point = np.where(size == 2, (b & 31) << 6 | more[0], np.where(size == 3, (b & 15) << 12 | more[0] << 6 | more[1], (b & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
        what = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            kind[lead[size > k] + k] = what[size > k]
    upper = np.flatnonzero((kind[:n] & UPPER > 0) & (data & 0xC0 != 0x80) & ~edge[:n])
    before = kind[upper - 1]
    after = upper + 1 + (data[upper] >= 0xC0) + (data[upper] >= 0xE0) + (data[upper] >= 0xF0)
    follows = (kind[after] & LOWER > 0) & ~edge[np.minimum(after, n)]
    start = np.zeros(n, dtype=bool)
    start[upper[(before & BEFORE > 0) | (before & UPPER > 0) & follows]] = True
    s, e = _spans(kind[:n] & WORD > 0, start, edge)
    long = e - s >= 2
    first = data[s]
    # The lower case of U+0130 has two characters.
    long = (s + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0) < e) | (first == 0xC4) & (padded[s + 1] == 0xB0)
    s, e = s[long], e[long]
    words = _column(_low(data), s, e)
    if len(lead):
        some = np.concatenate([[0], np.cumsum(data >= 128, dtype="int32")])
        words = _lowered(words, some[e] > some[s])
    return _row_of(rows, s), words


def runs(column, least: int = 2, most: int = 128):
    """Rows and runs of text.identifier_runs, with repeats."""
    import numpy as np

    data, rows = raw(column)
    inside = (data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122) | (data == 95)
    s, e = _spans(inside, np.zeros(len(data), dtype=bool), _edges(data, rows))
    some = (e - s >= least) & (e - s <= most)
    return _row_of(rows, s[some]), _column(data, s[some], e[some])


def folded(column):
    """Rows and words of text.folded_words."""
    import numpy as np

    data, rows = raw(column)
    edge = _edges(data, rows)
    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    start = np.zeros(len(data), dtype=bool)
    before = lambda x: x[:-1] & ~edge[1:-1]
    follows = np.zeros(len(data), dtype=bool)
    follows[:-1] = lower[1:] & ~edge[1:-1]
    start[1:] = upper[1:] & (~before(upper) | follows[1:]) | lower[1:] & ~before(lower) & ~before(upper) | digit[1:] & ~before(digit)
    s, e = _spans(upper | lower | digit, start, edge)
    s, e = s[e - s > 1], e[e - s > 1]
    low = _low(data)
    e = e - ((e - s > 4) & (low[e - 1] == 115) & (low[e - 2] != 115))
    return _row_of(rows, s), _column(low, s, e)


def identifiers(column):
    """text.normal_identifier of a column of strings."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.string()), "")
    wide = ~np.asarray(pc.string_is_ascii(column))
    low = pc.ascii_lower(pc.ascii_trim(column, characters="\t\n\x0b\x0c\r "))
    if not wide.any():
        return low
    some = _lowered(pc.utf8_trim(column, characters=SPACE), wide).filter(pa.array(wide))
    return pc.replace_with_mask(low, pa.array(wide), some)
