"""Per-document text quality: which texts are natural prose, and which are lists, tables, logs, code or junk.

A text is cut into segments (paragraphs, single long lines, runs of short lines of one layout). Each segment gets
the statistics in STATISTICS. For each language a robust mean and covariance of prose are fitted over the segments of
all documents: start from medians and median deviations, then refit on what lies near, several times. A segment's
squared Mahalanobis distance from the prose of its language says how unlike prose it is, and splits into one
contribution for each statistic. A document is outside natural language if most of its characters lie in segments
beyond the cut.

Mean and covariance are those of the plain statistics. Deviations count only where they speak against prose: below or
above a statistic's harmless limit (few common words are normal in terse notes, many are not) they are nil. Each
variance is widened by the square of a small floor, so that a statistic that hardly varies in prose doesn't decide
alone; where prose varies at all, its own variance is the larger part.

One statistic is the mean log probability of a word given the one before it, under pair counts over all documents.
The counts are kept in tables of fixed size with two hash rows; what other pairs are expected to add to a cell is
subtracted and the smaller row counts, so a pair never seen stays near zero however many others there are. The model
that goes to the workers doesn't grow with the corpus.

Each text is parsed once, its statistics and the numbers of its words are staged, and all else works on arrays of
them. Counts, medians and moments are sums over all documents, combined per partition before they are shuffled.

Defined results: null, empty and blank texts get zero words, no distance, and are no cases; segments under 30
characters are joined with short ones next to them, single ones (headings) count with what follows them; the language
is the one most of whose common words occur, whatever the row claims, the first one if none does; a language with too
few segments shares the fit of all; repeated rows are judged alike; texts are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.common import ship, stage

#: name, floor of the standard deviation, range for the starting medians, harmless limit, side that speaks against prose (1 above, -1 below, 0 both)
STATISTICS = [
    ("common_words", 0.02, 0.0, 1.0, 0.5, 1),  # share of the language's common words
    ("content_run", 0.14, 0.0, 8.0, 0.8, 1),  # log words between common words or punctuation
    ("word_length", 0.19, 0.0, 20.0, 0.0, 0),  # mean letters to a word, harmless near 4.6
    ("symbols", 0.006, 0.0, 1.0, 0.05, 1),  # share of characters that are neither letters nor digits
    ("digits", 0.006, 0.0, 1.0, 0.03, 1),
    ("broken_lines", 0.04, 0.0, 1.0, 0.0, 1),  # share of ends of short lines that neither punctuation nor wrapping explains
    ("lower_starts", 0.06, 0.0, 1.0, 0.0, 1),  # share of sentences that begin in lower case
    ("repetition", 0.04, 0.0, 1.0, 0.2, 1),  # share of word triples that occurred before in their stretch
    ("word_tokens", 0.016, 0.0, 1.0, 1.0, -1),  # share of tokens that are words with usual punctuation
    ("sentence_length", 0.05, 0.0, 8.0, 1.2, -1),  # log words to a sentence
    ("separators", 0.006, 0.0, 1.0, 0.02, 1),  # bare symbols, column gaps and item numbers to a token
    ("word_pairs", 0.1, -8.0, 0.0, -2.0, -1),  # mean log probability of a word after the one before
    ("word_count", 0.16, 0.0, 16.0, 1.4, -1),  # log words; many are harmless
    ("punctuated_lines", 0.08, 0.0, 1.0, 1.0, -1),  # share of lines that end in punctuation
]
NAMES = [s[0] for s in STATISTICS]
FLOOR, LIMIT, SIDE = (np.array([s[i] for s in STATISTICS], float) for i in (1, 4, 5))
K = len(STATISTICS)
LENGTH, PAIRS = NAMES.index("word_length"), NAMES.index("word_pairs")
#: Mean word lengths this near to this one are those of prose in any language.
USUAL_LENGTH, LENGTH_SPREAD = 4.6, 0.4
#: Prose has heavier tails than a normal distribution: segments are outside beyond so many times its quantile.
CUT = 6.0

PAIR_BUCKETS = 1 << 20
WORD_BUCKETS = 1 << 18
#: Segments that the fit rests on have at least so many characters; shorter ones than SHORT are joined.
FIT_CHARS, SHORT = 80, 30
LONG_LINE = 120
#: Text isn't wrapped to lines narrower than this.
NARROW = 36
#: Repetition is looked for in stretches of so many words, so that it doesn't grow with the text.
STRETCH = 200
ROUNDS = 7
BINS = 2000
#: Languages need so many segments for a fit of their own.
LEAST_SEGMENTS = 100
#: Words the table of common words may have; it goes to every worker.
MOST_COMMON_WORDS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_TOKEN = re.compile(r"[\"'(¿¡“„«`*_]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"')”»`*_]*[.,;:!?…]*[\"')”»`*_]*")
_MARK = re.compile(r"[ \t]*(?:(?://+|#+|\*+|>+|\||;+|--+|•|-|\+)(?:[ \t]+|$))?")
_EMPHASIS_RUN = re.compile(r"[*~`]+|_+")
_EMPHASIS = re.compile(r"[*~`]|_")
_BLANK = re.compile(r"\n[ \t]*\n")
#: Blanks that compatibility forms leave as they are.
_ODD_BLANKS = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\u1680\u180e\u2028\u2029"
_ITEM = re.compile(r"\(?\d+[.)]\s|\[[ xX]\]")
_STOP = re.compile(r"[.!?][\"”)]?$")
_FIRST = re.compile(r"[\"“(]?([^\W\d_])")
_END = (".", "!", "?", '."', '!"', '?"', ".)", ".”", ":", "…")


def plain(text: str) -> str:
    """Compatibility forms, line ends, blanks and emphasis made one."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    for c in _ODD_BLANKS:
        if c in text:
            text = text.replace(c, " ")
    return _EMPHASIS_RUN.sub(_emphasis, text) if _EMPHASIS.search(text) else text


def _emphasis(m: re.Match) -> str:
    """Nothing for marks around words, the marks themselves elsewhere."""
    run, text, a, b = m.group(), m.string, m.start(), m.end()
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    if run[0] == "_":
        return "" if len(run) < 3 and before.isalnum() != after.isalnum() else run
    return "" if len(run) < 4 and (after == "_" or after.isalnum() or before.isalnum() or before in "_.,;:!?)") else run


def _mark(line: str) -> str:
    return _MARK.match(line).group().strip()


def _wraps(line: str, following: str, width: int) -> bool:
    """Whether punctuation or the lack of room explains that the line ends here."""
    return line.endswith(_END) or width >= NARROW and len(line) + 1 + len(following.split(" ", 1)[0]) > width


def segments(text: str) -> Iterator[tuple[int, list[str]]]:
    """(characters, lines without their common mark) of each segment of a plain text."""
    for block in _BLANK.split(text):
        runs: list[list[tuple[str, str, int, bool]]] = []
        words = 0
        for line in block.split("\n"):
            n = len(line.split())
            if not n:
                continue
            mark, long = _mark(line), len(line) >= LONG_LINE and n >= 8
            if not runs or long or runs[-1][-1][3] or mark != runs[-1][-1][1] and max(words, n) >= 6:
                runs.append([])
                words = 0
            runs[-1].append((line, mark, n, long))
            words = max(words, n)
        for raw in runs:
            sizes, first = [len(r[0]) for r in raw], raw[0]
            cut = len(first[1]) if len(raw) > 1 and all(r[1] == first[1] for r in raw) else 0
            lines = [r[0].strip()[cut:].strip() if cut else r[0].strip() for r in raw]
            if len(lines) > 1 and len(lines[0].split()) <= 9 and not lines[0].endswith((".", "!", "?", ",", ";")) and not _wraps(lines[0], lines[1], max(map(len, lines))):
                yield sizes[0], lines[:1]
                sizes, lines = sizes[1:], lines[1:]
            yield sum(sizes), lines


class Tokens:
    """What is known of tokens, by number. Texts repeat their tokens, so it is looked up; the table starts anew when it is full."""

    MOST = 100_000
    #: words, number as a word (0 if it isn't one), letters, symbols, digits, bare of letters and digits, ends a phrase, ends a sentence, ends one before a start, first letter (1 lower, 2 other), key of its words
    FACTS = 11

    def __init__(self, common: dict[str, frozenset[str]]):
        self.common = list(common.items())
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.facts = np.zeros((1024, self.FACTS + len(self.common)), np.int64)

    def _add(self, token: str) -> int:
        words = [w.lower() for w in _WORD.findall(token)]
        whole = 0
        if _TOKEN.fullmatch(token):
            whole = word_number(token.strip('.,;:!?()"').lower() if "-" in token else words[0])
        n = len(self.numbers)
        if n == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        first = _FIRST.match(token)
        self.facts[n] = [
            len(words), whole, sum(map(len, words)), len(re.findall(r"[^\w ]|_", token)), len(re.findall(r"\d", token)), not any(c.isalnum() for c in token),
            token[-1] in ".,;:!?", token[-1] in ".!?", bool(_STOP.search(token)), (1 if first[1].islower() else 2) if first else 0,
            zlib.crc32(" ".join(words).encode()), *[sum(map(known.__contains__, words)) for _, known in self.common],
        ]
        self.numbers[token] = n
        return n

    def of(self, tokens: list[str]) -> np.ndarray:
        """A row of facts for each token."""
        if len(self.numbers) > self.MOST:
            self.clear()
        known = self.numbers.get
        at = [n if (n := known(t)) is not None else self._add(t) for t in tokens]
        return self.facts[np.array(at, np.int64)] if at else self.facts[:0]


def word_number(word: str) -> int:
    return zlib.crc32(word.encode()) or 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers with all their bits stirred."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def word_pairs(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of words next to each other within segments, which begin at `starts`: position, hash of the pair, number of its first word. What isn't a word parts them."""
    ok = (numbers[:-1] > 0) & (numbers[1:] > 0)
    inner = starts[(starts > 0) & (starts < len(numbers))]
    ok[inner - 1] = False
    at = np.flatnonzero(ok)
    first, second = numbers[at].astype(np.uint64), numbers[at + 1].astype(np.uint64)
    return at, mixed(first * np.uint64(0x9E3779B97F4A7C15) + second), first


def buckets(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A cell for each hash in each of two rows."""
    return (hashes & np.uint64(size - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)


def joined(parts: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """Segments with short ones made one with their short neighbours; the characters of single ones go to the next, or at the end to the one before."""
    out: list[tuple[int, list[str]]] = []
    extra = i = 0
    while i < len(parts):
        j = i
        while j < len(parts) and parts[j][0] < SHORT:
            j += 1
        if j - i > 1:
            out.append((extra + sum(n for n, _ in parts[i:j]), [x for _, lines in parts[i:j] for x in lines]))
            extra = 0
        elif j - i == 1:
            extra += parts[i][0]
        if j < len(parts):
            out.append((extra + parts[j][0], parts[j][1]))
            extra = 0
        i = j + 1
    if extra and out:
        out[-1] = (out[-1][0] + extra, out[-1][1])
    return out if out else parts


def layout(lines: list[str]) -> tuple[float, int, float]:
    """Of a segment: share of broken lines, column gaps and item numbers, share of lines that end in punctuation."""
    broken = gaps = 0
    if len(lines) > 1:
        width = max(map(len, lines))
        broken = sum(len(a.split(None, 8)) < 9 and not _wraps(a, b, width) for a, b in zip(lines, lines[1:])) / (len(lines) - 1)
        gaps = sum(bool(_ITEM.match(x)) for x in lines)
    text = "\n".join(lines)
    if "  " in text or "\t" in text:
        wide, narrow = len(re.findall(r"(?<=\S)(?: {2,}|\t)(?=\S)", text)), len(re.findall(r"(?<=\S) (?=\S)", text))
        if 4 * narrow > wide or re.search(r"   |\t", text):  # else it is doubled spacing throughout
            gaps += wide
    return broken, gaps, sum(x.endswith(_END) for x in lines) / max(1, len(lines))


def statistics(docs: list[list[tuple[int, list[str]]]], tokens: Tokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments of several texts: language of each text, segments of each, statistics of each segment but for word pairs, tokens of each segment, numbers of the tokens as words."""
    flat: list[str] = []
    shape, chars, n_tokens = [], [], []
    for parts in docs:
        for _, lines in parts:
            before = len(flat)
            for x in lines:
                flat += x.split()
            n_tokens.append(len(flat) - before)
            shape.append(layout(lines))
            chars.append(sum(map(len, lines)) - sum(x.count(" ") for x in lines))
    facts = tokens.of(flat)
    stop = np.cumsum(np.array(n_tokens, np.int64))
    start = stop - n_tokens
    sums = np.concatenate([np.zeros((1, facts.shape[1]), np.int64), np.cumsum(facts, 0)])
    total = sums[stop] - sums[start]
    n_parts = np.array([len(p) for p in docs], np.int64)
    ends = np.cumsum(n_parts)
    edges = np.concatenate([[0], stop])
    by_doc = sums[edges[ends]][:, Tokens.FACTS :] - sums[edges[ends - n_parts]][:, Tokens.FACTS :]
    best = by_doc.argmax(1) if by_doc.shape[1] else np.zeros(len(docs), np.int64)  # the first of equal ones
    of = np.repeat(best, n_parts)
    n_common = total[np.arange(len(of)), Tokens.FACTS + of] if by_doc.shape[1] else np.zeros(len(of), np.int64)
    words, _, letters, symbols, digits, bare, breaks = total[:, :7].T
    chars, tokens_of = np.maximum(1, chars), np.maximum(1, n_tokens)
    own = np.repeat(np.arange(len(stop)), n_tokens)
    # sentences: ends with words since the end before them, and what is left open
    end = np.flatnonzero(facts[:, 7])
    since = np.maximum(np.concatenate([[0], end[:-1] + 1])[: len(end)], start[own[end]])
    sentences = np.bincount(own[end], sums[end + 1, 0] > sums[since, 0], len(stop))
    last = start.copy()
    last[own[end]] = end + 1
    sentences += sums[stop, 0] > sums[last, 0]
    # starts of sentences
    nxt = np.flatnonzero((facts[:-1, 8] > 0) & (facts[1:, 9] > 0) & (own[:-1] == own[1:])) if len(facts) else np.zeros(0, np.int64)
    starts, lower = np.bincount(own[nxt], minlength=len(stop)), np.bincount(own[nxt], facts[nxt + 1, 9] == 1, len(stop))
    # triples of tokens with words, in stretches
    worded = np.flatnonzero(facts[:, 0])
    seg = own[worded]
    place = np.arange(len(worded)) - np.searchsorted(seg, seg)
    k = facts[worded, 10].astype(np.uint64)
    three = np.flatnonzero(seg[:-2] == seg[2:]) if len(worded) > 2 else np.zeros(0, np.int64)
    triple = mixed(mixed(k[three] * np.uint64(0x9E3779B97F4A7C15) + k[three + 1]) + k[three + 2])
    stretch = seg[three].astype(np.uint64) * np.uint64(0x100000000) + (place[three] // STRETCH).astype(np.uint64)
    _, once = np.unique(triple ^ mixed(stretch), return_index=True)
    n_triples, distinct = np.bincount(seg[three], minlength=len(stop)), np.bincount(seg[three[once]], minlength=len(stop))
    broken, gaps, punctuated = np.array(shape, float).reshape(-1, 3).T
    x = np.zeros((len(stop), K))
    some = np.maximum(1, words)
    for i, v in enumerate([
        n_common / some, np.log((words + 1) / (n_common + breaks + 1)), letters / some, symbols / chars, digits / chars, broken, np.where(starts > 1, lower / np.maximum(1, starts), 0.0),
        np.where(n_triples > 5, 1 - distinct / np.maximum(1, n_triples), 0.0), np.bincount(own, facts[:, 1] > 0, len(stop)) / tokens_of, np.where(sentences > 0, np.log((words + 1) / (sentences + 1)), 0.0),
        (bare + gaps) / tokens_of, np.zeros(len(stop)), np.log1p(words), punctuated,
    ]):
        x[:, i] = v
    names = [name for name, _ in tokens.common] or [""]
    return [names[b] for b in best], n_parts, x, np.array(n_tokens, np.int64), facts[:, 1]


def chi_squared(p: float, k: int) -> float:
    """Quantile by the cube-root normal approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _parse(shared):
    """(doc_id, language, sizes, statistics, tokens, words): what is known of each text by itself."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _TABLE.get("of") != token:
            _TABLE.update({"of": token, "tokens": Tokens(shared.value)})
        tokens = _TABLE["tokens"]
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                docs = [joined(list(segments(plain(text)))) for text in batch.column(1).to_pylist()]
                langs, n_parts, x, n_tokens, numbers = statistics(docs, tokens)
                stop = np.concatenate([[0], np.cumsum(n_parts)])
                lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(langs, pa.string()), lists(stop, pa.array([n for parts in docs for n, _ in parts], pa.int64())), lists(stop * K, pa.array(x.ravel(), pa.float64())),
                        lists(stop, pa.array(n_tokens, pa.int32())), lists(np.concatenate([[0], np.cumsum(n_tokens)])[stop], pa.array(numbers.astype(np.uint32).view(np.int32), pa.int32())),
                    ],
                    ["doc_id", "language", "sizes", "statistics", "tokens", "words"],
                )

    return run


#: A worker's table of tokens. Texts are parsed so many at a time.
_TABLE: dict = {}
CHUNK = 500


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of lists."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _pairs_in(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of the pairs in a batch: document, segment, hash, first word; and the number of segments."""
    n_tokens = _flat(batch.column("tokens"))[1].astype(np.int64)
    n_words, words = _flat(batch.column("words"))
    starts = np.cumsum(n_tokens) - n_tokens
    at, pair, first = word_pairs(words.view(np.uint32).astype(np.int64), starts)
    return np.repeat(np.arange(len(n_words)), n_words)[at], np.repeat(np.arange(len(n_tokens)), n_tokens)[at], pair, first, len(n_tokens)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes = (PAIR_BUCKETS, PAIR_BUCKETS, WORD_BUCKETS, WORD_BUCKETS)
    tables = [np.zeros(size, np.int64) for size in sizes]
    for batch in batches:
        doc, _, pair, first, _ = _pairs_in(batch)
        for hashes, at in ((pair, 0), (mixed(first), 2)):
            _, once = np.unique(hashes ^ mixed(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
            for row, cells in enumerate(buckets(hashes[once], sizes[at])):
                tables[at + row] += np.bincount(cells, minlength=sizes[at])
    for kind, table in enumerate(tables):
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["kind", "bucket", "n"])


def pair_model(parsed: DataFrame) -> list[np.ndarray]:
    """In how many documents each cell's pairs, and each cell's first words of pairs, occur. Fixed size."""
    sums = parsed.select("tokens", "words").mapInArrow(_count_pairs, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    kind, bucket, n = (sums.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    tables = []
    for k, size in enumerate((PAIR_BUCKETS, PAIR_BUCKETS, WORD_BUCKETS, WORD_BUCKETS)):
        t = np.zeros(size, np.int64)
        t[bucket[kind == k]] = n[kind == k]
        tables.append(t)
    return tables


def expected(tables: list[np.ndarray]) -> list[np.ndarray]:
    """Counts without what other entries are expected to add to a cell."""
    return [(t - (t.sum() - t) / (len(t) - 1)).astype(np.float32) for t in tables]


def _score(shared):
    """Puts the statistic of word pairs in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for batch in batches:
            _, seg, pair, first, n_segments = _pairs_in(batch)
            count = []
            for hashes, at, size in ((pair, 0, PAIR_BUCKETS), (mixed(first), 2, WORD_BUCKETS)):
                a, b = buckets(hashes, size)
                count.append(np.maximum(0.0, np.minimum(rows[at][a], rows[at + 1][b]).astype(np.float64) - 1))  # the text itself doesn't count
            log = np.maximum(-7.0, np.log((count[0] + 0.02) / (count[1] + 2)))
            x = _flat(batch.column("statistics"))[1].reshape(-1, K).copy()
            x[:, PAIRS] = (np.bincount(seg, log, n_segments) - 2.0 * 6) / (np.bincount(seg, minlength=n_segments) + 6)
            statistics_ = pa.ListArray.from_arrays(pa.array(batch.column("statistics").offsets.to_numpy() - batch.column("statistics").offsets[0].as_py(), pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), batch.column("sizes"), statistics_], ["doc_id", "language", "sizes", "statistics"])

    return run


def _unnest(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all segments: language, characters, statistics."""
    sizes, values = batch.column("sizes"), batch.column("statistics")
    n = np.diff(sizes.offsets.to_numpy())
    lang = np.repeat(np.array(batch.column("language").to_pylist(), object), n)
    return lang, sizes.flatten().to_numpy(), values.flatten().to_numpy(zero_copy_only=False).reshape(-1, K)


def against(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Deviations from the mean as far as they speak against prose: beyond the harmless limit, on the side that counts."""
    low, high = np.maximum(x, LIMIT) - np.maximum(mean, LIMIT), np.minimum(x, LIMIT) - np.minimum(mean, LIMIT)
    z = np.where(SIDE > 0, low, np.where(SIDE < 0, high, x - mean))
    z[:, LENGTH] = np.maximum(np.abs(x[:, LENGTH] - USUAL_LENGTH) - LENGTH_SPREAD, 0.0)
    return z


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lo, hi = np.array([s[2] for s in STATISTICS]), np.array([s[3] for s in STATISTICS])
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        lang, size, x = _unnest(batch)
        bins = np.clip(((x - lo) / (hi - lo) * BINS).astype(int), 0, BINS - 1)
        for name in set(lang):
            mine = bins[(lang == name) & (size >= FIT_CHARS)]
            table = sums.setdefault(name, np.zeros((K, BINS), np.int64))
            for k in range(K):
                table[k] += np.bincount(mine[:, k], minlength=BINS)
    for name, table in sums.items():
        k, b = np.nonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(table[k, b], pa.int64())], ["language", "k", "bin", "n"]
        )


def _moments(fits: dict, first: bool, limit: float):
    """Sums over the segments within the current fit: count, values, products; one row each language and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, size, x = _unnest(batch)
            for name in set(lang):
                mine = x[(lang == name) & (size >= FIT_CHARS)]
                mean, scale = fits.get(name, fits[""])
                z = against(mine, mean)
                if first:
                    near = mine[(np.abs(z) / scale).max(1, initial=0) < 4]
                else:
                    near = mine[np.einsum("ij,jk,ik->i", z, scale, z) < limit]
                row = np.concatenate([[len(near)], near.sum(0), (near.T @ near).ravel()])
                sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([row], pa.list_(pa.float64()))], ["language", "sums"])

    return run


def _median(table: np.ndarray, lo: float, hi: float) -> tuple[float, float]:
    """Median and median deviation of a histogram."""
    mid = lo + (np.arange(BINS) + 0.5) * (hi - lo) / BINS
    total = table.sum()
    med = mid[np.searchsorted(np.cumsum(table), (total + 1) / 2)]
    off = np.abs(mid - med)
    order = np.argsort(off, kind="stable")
    return med, off[order][np.searchsorted(np.cumsum(table[order]), (total + 1) / 2)]


def fit_prose(measured: DataFrame, limit: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language -> mean and inverse covariance of its prose; '' is the fit over all languages."""
    rows = measured.mapInArrow(_histograms, "language string, k int, bin int, n long").groupBy("language", "k", "bin").agg(F.sum("n").alias("n")).toArrow()
    tables: dict[str, np.ndarray] = {"": np.zeros((K, BINS), np.int64)}
    for name, k, b, n in zip(*(rows.column(c).to_pylist() for c in ("language", "k", "bin", "n"))):
        for key in (name, ""):
            tables.setdefault(key, np.zeros((K, BINS), np.int64))[k, b] += n
    own = [n for n, t in tables.items() if n == "" or t[0].sum() >= LEAST_SEGMENTS]
    if tables[""].sum() == 0:
        return {"": (np.array([0.45, 0.55, 4.6, 0.03, 0.01, 0, 0, 0, 0.97, 2.5, 0, -1.3, 4, 1]), np.diag(1 / (3 * FLOOR) ** 2))}
    start = {}
    for name in own:
        pairs = [_median(tables[name][k], STATISTICS[k][2], STATISTICS[k][3]) for k in range(K)]
        start[name] = np.array([p[0] for p in pairs]), np.hypot(1.4826 * np.array([p[1] for p in pairs]), 3 * FLOOR)
    fits, first = start, True
    for _ in range(ROUNDS):
        part = measured.mapInArrow(_moments(fits, first, limit), "language string, sums array<double>")
        sums = part.select("language", F.posexplode("sums")).groupBy("language", "pos").agg(F.sum("col").alias("s")).toArrow()
        got: dict[str, np.ndarray] = {"": np.zeros(1 + K + K * K)}
        for name, pos, s in zip(*(sums.column(c).to_pylist() for c in ("language", "pos", "s"))):
            got.setdefault(name, np.zeros(1 + K + K * K))[pos] = s
            got[""][pos] += s
        fits, first = {}, False
        for name in own:
            row = got.get(name)
            if row is None or row[0] < 2:
                mean, cov = start[name][0], np.diag(start[name][1] ** 2)
            else:
                mean = row[1 : 1 + K] / row[0]
                cov = row[1 + K :].reshape(K, K) / row[0] - np.outer(mean, mean)
            fits[name] = mean, np.linalg.inv(cov + np.diag(FLOOR**2))
    return fits


def _judge(fits: dict, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, size, x = _unnest(batch)
            parts = np.zeros_like(x)
            for name in set(lang):
                mine = lang == name
                mean, inverse = fits.get(name, fits[""])
                z = against(x[mine], mean)
                parts[mine] = z * (z @ inverse)
            far = parts.sum(1) > CUT * limit
            ends = np.cumsum(np.diff(batch.column("sizes").offsets.to_numpy()))
            share, distance, why = [], [], []
            begin = 0
            for end in ends:
                s, f, p = size[begin:end], far[begin:end], parts[begin:end]
                begin = end
                total = s.sum()
                if not total:
                    share.append(None), distance.append(None), why.append(None)
                    continue
                share.append(float(s[f].sum() / total))
                mean_parts = (p * s[:, None]).sum(0) / total
                distance.append(float(math.sqrt(max(0.0, mean_parts.sum()))))
                why.append(list(zip(NAMES, mean_parts.tolist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("language"), pa.array(share, pa.float64()), pa.array(distance, pa.float64()), pa.array(why, pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "language", "outside_share", "distance", "contributions"],
            )

    return run


def common_table(common_words: DataFrame) -> dict[str, set[str]]:
    """Language -> its common words in lower case. The table goes to every worker, so its size is checked."""
    words = common_words.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", F.lower("word").alias("word")).distinct()
    if words.limit(MOST_COMMON_WORDS + 1).count() > MOST_COMMON_WORDS:
        raise ValueError("the table of common words is too large to be sent to the workers")
    common: dict[str, set[str]] = {}
    for r in words.orderBy("lang", "word").collect():
        common.setdefault(r.lang, set()).add(r.word)
    return common


def quality(documents: DataFrame, common_words: DataFrame, quantile: float = 0.995) -> DataFrame:
    """(doc_id, language, outside_share, distance, contributions) of every row with text.

    outside_share: share of characters in segments too far from prose; distance: root of the mean squared distance;
    contributions: what each statistic adds to the squared distance.
    """
    spark = documents.sparkSession
    ship(spark)
    limit = chi_squared(quantile, K)
    common = common_table(common_words)
    texts = documents.where("text IS NOT NULL AND text RLIKE '\\\\S'").select("doc_id", "text")
    kind = dict(texts.dtypes)["doc_id"]
    known = spark.sparkContext.broadcast({k: frozenset(v) for k, v in common.items()})
    schema = f"doc_id {kind}, language string, sizes array<bigint>, statistics array<double>"
    parsed = stage(texts.mapInArrow(_parse(known), schema + ", tokens array<int>, words array<int>"), "parsed")
    model = spark.sparkContext.broadcast(expected(pair_model(parsed)))
    measured = stage(parsed.mapInArrow(_score(model), schema), "quality")
    fits = fit_prose(measured, limit)
    return measured.mapInArrow(_judge(fits, limit), f"doc_id {kind}, language string, outside_share double, distance double, contributions map<string,double>")
