"""Evaluation texts leaking into training text.

All runs of `words` consecutive words of the held-out items go, normalised and without what parts their words, into
one Aho-Corasick automaton; each document is normalised in the same way and scanned once. A hit's word boundaries are
then held against the document's: whatever certainly parts words there must part them in the item, and where the item
parts words the document must, or may, do so too.

A word is a run of letters or digits after compatibility normalisation and case folding. What layout puts into a text
may or may not part words, and is decided hit by hit and place by place: tags, hyphens at line ends, invisible
characters. Character references stand for their characters. Whether something in angle brackets is a tag can't be
told by itself, so a text that has any is scanned with all of them taken as tags, with only those of known elements
or with attributes, and with none.

For documents with hits, characters of the scanned form are traced back piece by piece, a piece being the shortest
stretch that normalises by itself, so every leak is reported with its offsets in the original.

The automaton's texts are sent to every worker, so their size is checked: beyond `block_chars` characters the items
are split by hash into blocks, each of which is scanned for over all documents in its turn.

Defined results: null and empty texts match nothing, nor do items of fewer than `words` words; repeated rows of a
document or item count once; rows with a null id are left out; documents are never cut or skipped for their length.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.common import ship

WORDS = 10
BLOCK_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")
#: Stands in scanned texts where layout may part words; texts that hold it themselves get a blank in its place.
SOFT = ""
_HYPHEN = r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n[\s>*#|/;\-]*(?=[^\W\d_])"
_INVISIBLE = "[­​-‍⁠﻿]"
_REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]*+|#\d++|#[xX][0-9A-Fa-f]++);"
_TAG = r"</?[A-Za-z!][^<>]*+>"
#: Elements whose tags are markup for certain.
ELEMENTS = (
    "a abbr article aside b blockquote body br code dd del div dl dt em figure font footer h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd li "
    "link main mark meta nav ol p pre q s section small span strong style sub sup svg table tbody td th thead title tr tt u ul"
).split()
_MARKUP = rf"<(?:!(?:--)?|/?(?i:{'|'.join(ELEMENTS)})(?=[\s/>])|/|[A-Za-z][\w:-]*\s+[\w:-]+\s*=)[^<>]*+>"
_SURE = f"{_REFERENCE}|{_HYPHEN}|{_INVISIBLE}"
#: What is layout in each reading of a text.
_READINGS = [re.compile(f"{tags}|{_SURE}" if tags else _SURE) for tags in (_TAG, _MARKUP, "")]
_ANY = re.compile(f"<(?=[/A-Za-z!])|{SOFT}|{_SURE}")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def _layout_as(m: re.Match) -> str:
    s = m.group()
    return html.unescape(s) if s[0] == "&" else SOFT


def forms(text: str) -> list[re.Pattern | None]:
    """What to take as layout in each reading of the text that differs from those before; None for a text without any."""
    if not _ANY.search(text):
        return [None]
    if "<" not in text:
        return [_READINGS[2]]
    found, out = [], []
    for reading in _READINGS:
        spans = [m.span() for m in reading.finditer(text)]
        if spans not in found:
            found.append(spans)
            out.append(reading)
    return out


def form(text: str, layout: re.Pattern | None) -> str:
    """The folded text with marks where layout is."""
    if layout is None:
        return fold(text)
    return fold(layout.sub(_layout_as, text.replace(SOFT, " ")))


def letters(folded: str) -> str:
    return "".join(_WORD.findall(folded))


def borders(folded: str) -> tuple[dict[int, bool], int]:
    """Places in the letters where words are parted, for certain (True) or maybe; and the number of letters."""
    at, last, out = 0, 0, {0: True}
    for m in _WORD.finditer(folded):
        if at:
            out[at] = folded[last : m.start()].strip(SOFT) != ""
        at += m.end() - m.start()
        last = m.end()
    out[at] = True
    return out, at


def runs(text: str, words: int) -> Iterator[list[str]]:
    """Every run of `words` consecutive words of an item, in each of its readings, layout parting words or not."""
    for layout in forms(text):
        folded = form(text, layout)
        for flat in {folded.replace(SOFT, " "), folded.replace(SOFT, "")}:
            ws = _WORD.findall(flat)
            for i in range(len(ws) - words + 1):
                yield ws[i : i + words]


def automaton(items: list[tuple[int, str]], words: int):
    """Letters of each run -> how it is parted into words, and the items that have it so."""
    import ahocorasick

    owners: dict[str, dict[tuple[int, ...], set[int]]] = {}
    for item, text in items:
        for ws in runs(text or "", words):
            inner, at = [], 0
            for w in ws[:-1]:
                at += len(w)
                inner.append(at)
            owners.setdefault("".join(ws), {}).setdefault(tuple(inner), set()).add(item)
    auto = ahocorasick.Automaton()
    for run, ways in owners.items():
        auto.add_word(run, (len(run), [(inner, sorted(ids)) for inner, ids in sorted(ways.items())]))
    auto.make_automaton()
    return auto if owners else None


def hits(folded: str, auto) -> Iterator[tuple[int, int, tuple[int, ...], list[int]]]:
    """(start, end, places between words, items) of every run whose words the text parts in the same way, in letters."""
    where = sorted_ = None
    for stop, (n, ways) in auto.iter(letters(folded)):
        if where is None:
            where, _ = borders(folded)
            sorted_ = sorted(b for b, sure in where.items() if sure)
        end, start = stop + 1, stop + 1 - n
        if start not in where or end not in where:
            continue
        sure = sorted_[bisect.bisect_right(sorted_, start) : bisect.bisect_left(sorted_, end)]
        for inner, ids in ways:
            places = {start + i for i in inner}
            if places.issuperset(sure) and all(p in where for p in places):
                yield start, end, tuple(sorted(places)), ids


def traced(text: str, layout: re.Pattern | None) -> list[tuple[int, int]]:
    """Of each letter of the form: the stretch of the original that it comes from."""
    spans: list[tuple[int, int]] = []

    def add(folded: str, a: int, b: int) -> None:
        for m in _WORD.finditer(folded):
            spans.extend([(a, b)] * (m.end() - m.start()))

    def plain(a: int, b: int) -> None:
        i = a
        while i < b:
            j, got = i + 1, fold(text[i])
            while j < b and not text[j].isascii() and fold(text[i : j + 1]) != got + fold(text[j]):
                j += 1
                got = fold(text[i:j])
            add(got, i, j)
            i = j

    at = 0
    for m in layout.finditer(text) if layout else ():
        plain(at, m.start())
        add(fold(_layout_as(m)), m.start(), m.end())
        at = m.end()
    plain(at, len(text))
    return spans


def leaks(text: str, auto) -> list[tuple[int, int, int, int]]:
    """(item, start, end, words) of every maximal run of leaked words, as offsets in the text."""
    found: list[tuple[int, int, int, int]] = []
    for layout in forms(text):
        folded = form(text, layout)
        mine: dict[int, list] = {}
        for start, end, places, ids in hits(folded, auto):
            for item in ids:
                mine.setdefault(item, []).append((start, end, {*places, end}))
        if not mine:
            continue
        spans = traced(text, layout)
        if len(spans) != len(letters(folded)):  # letters that normalise only across more than neighbours: the text as a whole
            spans = [(0, len(text))] * len(letters(folded))
        for item, rows in mine.items():
            merged: list[list] = []
            for start, end, places in sorted(rows, key=lambda r: r[:2]):
                if merged and start < merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                    merged[-1][2] |= places
                else:
                    merged.append([start, end, set(places)])
            found += [(item, spans[a][0], spans[b - 1][1], len(places)) for a, b, places in merged]
    # what one reading finds inside a span of another adds nothing
    found = sorted(set(found))
    return [x for x in found if not any(y != x and y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] and (y[2] - y[1], y[3]) > (x[2] - x[1], x[3]) for y in found)]


def leaked(text: str, auto) -> set[int]:
    """Items of which the text has a run."""
    return {item for layout in forms(text) for *_, ids in hits(form(text, layout), auto) for item in ids}


_CACHE: dict[str, object] = {}


def _scanner(shared, words: int, spans: bool):
    token = uuid.uuid4().hex  # one automaton for each worker and block of items

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _CACHE:
            _CACHE.clear()
            _CACHE[token] = automaton(shared.value, words)
        auto = _CACHE[token]
        for batch in batches:
            out: list[tuple] = []
            if auto is not None:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        out += [(doc, *leak) for leak in leaks(text, auto)] if spans else [(doc, i) for i in leaked(text, auto)]
            names = ["doc_id", "item_id", "start", "stop", "n_words"][: 5 if spans else 2]
            cols = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return scan


def find_leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, spans: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) or, with `spans`, (doc_id, item_id, start, stop, n_words) of every leak."""
    spark = documents.sparkSession
    ship(spark)
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long" + (", start long, stop long, n_words long" if spans else "")
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in part.toLocalIterator()))
        found = docs.mapInArrow(_scanner(shared, words, spans), schema)
        out = found if out is None else out.unionAll(found)
    return out.distinct()
