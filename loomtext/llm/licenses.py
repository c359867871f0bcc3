"""License scans: ordered signature rules behind a keyword prefilter.

White space counts as one blank however long it is, so that notices are found
across line ends. One pass of a keyword automaton over a lower-cased text tells
which of the hand-written regexes of ``license_rules`` can match at all; those
are run, in order. Overlapping detections are resolved by priority, then length, then rule
order: one that lies inside a stronger one is suppressed.

Apart from that, the base phrases are found exactly: every place where a
phrase's words stand one after another, whatever stands between them that isn't
a word. Suppression never touches base labels.

A document's score is the confidence that it carries a licence or a rights
notice: 1 minus the product of (1 - confidence) over its labels; 0 without any.
Null texts read as empty: no words, no labels, score 0. Repeated rows and equal
or null ids are scanned each. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import RULES
from .textkit import Words, buffers, column, hash_of, slices

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.9


@cache
def rules() -> tuple[list[tuple[str, int, float, str, re.Pattern]], ahocorasick.Automaton]:
    out = []
    for line in RULES.strip().splitlines():
        label, priority, sure, word, regex = line.split(" | ", 4)
        out.append((label.strip(), int(priority), float(sure), word, re.compile(regex, re.ASCII)))
    words: dict[str, list[int]] = {}
    for i, r in enumerate(out):
        words.setdefault(r[3], []).append(i)
    automaton = ahocorasick.Automaton()
    for w, which in words.items():
        automaton.add_word(w, which)
    automaton.make_automaton()
    return out, automaton


def detect(text: str, gated: bool = True) -> list[tuple[int, int, str, float]]:
    """Detections (start, end, label, confidence) in a lower-cased text, after suppression, by place. gated: without the rules that can't match, with the same result."""
    table, automaton = rules()
    tried = sorted({i for _, which in automaton.iter(text) for i in which}) if gated else range(len(table))
    found = []
    for i in tried:
        label, priority, sure, _, regex = table[i]
        found += [(-priority, m.start() - m.end(), i, m.start(), m.end(), label, sure) for m in regex.finditer(text)]
    found.sort()
    kept: list[tuple] = []
    # A kept span that starts at or before this one and ends at or after it contains it.
    starts: list[int] = []
    reach: list[int] = []


    for x in found:
        k = bisect_right(starts, x[3])
        if k and reach[k - 1] >= x[4]:
            continue
        if k < len(starts) and starts[k] == x[3]:
            reach[k] = max(reach[k], x[4])
        else:
            starts.insert(k, x[3])
            reach.insert(k, max(x[4], reach[k - 1] if k else 0))
        for j in range(k + 1, len(reach)):
            if reach[j] >= reach[k]:
                break
            reach[j] = reach[k]
        kept.append(x)
    return sorted((x[3], x[4], x[5], x[6]) for x in kept)


_SPACE = re.compile("[ \t\n\r\f\v]+")


def detect_in(text: str) -> list[tuple[int, int, str, float]]:
    """Detections in a lower-cased text with any white space, by their places in it."""
    found = detect(_SPACE.sub(" ", text))
    if not found:
        return found
    # Of each run of white space its place in the folded text, and how much was folded up to it.
    at, gone, total = [0], [0], 0
    for m in _SPACE.finditer(text):
        if m.end() - m.start() > 1:
            at.append(m.start() - total + 1)
            total += m.end() - m.start() - 1
            gone.append(total)
    back = lambda i: i + gone[bisect_right(at, i) - 1]
    return [(back(a), back(b - 1) + 1, label, sure) for a, b, label, sure in found]


def base_places(words: Words, phrases: dict[str, str]) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """For each phrase: the texts and the first words (from 0 in the text) of all its places, and its label."""
    text, out = words.text_of(), []
    h = words.hashes
    for phrase, label in phrases.items():
        codes = [np.uint64(hash_of(w)) for w in phrase.split()]
        at = np.flatnonzero(h == codes[0])
        for j, c in enumerate(codes[1:], 1):
            at = at[at + j < len(h)]
            at = at[(h[at + j] == c) & (text[at + j] == text[at])]
        out.append((text[at], at - words.first[text[at]], label))
    return out


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch], phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        data, off = buffers(column(part, "text"))
        words = Words(data, off)
        n = len(words.count)
        count, first, last = np.zeros(n, np.int64), np.full(n, 2**62), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for text, at, label in base_places(words, phrases):
            np.add.at(count, text, 1)
            np.minimum.at(first, text, at)
            np.maximum.at(last, text, at)
            for t in np.unique(text).tolist():
                base[t].add(label)
        low = words.low.tobytes()
        labels, scores, spans = [], [], []
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            found = detect_in(low[a:b].decode("utf-8", "replace"))
            sure: dict[str, float] = dict.fromkeys(base[i], BASE_CONFIDENCE)
            for _, _, label, s in found:
                sure[label] = max(s, sure.get(label, 0))
            labels.append(",".join(sorted(sure)))
            miss = 1.0
            for label in sorted(sure):
                miss *= 1 - sure[label]
            scores.append(1 - miss)
            spans.append([{"start": x[0], "end": x[1], "label": x[2]} for x in found])
        none = count == 0
        yield pa.RecordBatch.from_arrays(
            [column(part, "doc_id"), pa.array(words.count.astype(np.int64)), pa.array(count), pa.array(first, mask=none), pa.array(last.astype(np.int64), mask=none), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


def scan(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (in characters)."""
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, phrases=phrases or BASE_PHRASES), SCANNED)
