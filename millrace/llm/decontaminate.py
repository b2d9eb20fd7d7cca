"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every training document is a query. Items are indexed by length class; a class of items of up to n
words is searched with passages of 2.5n words, 0.5n apart, so any 2n + 1 words of a document fall into one passage: an item's
whole text does, with as many words again between its question and its answer, wherever it stands. Scores are
divided by the item's score for its own text, so one threshold serves all items. Sums over the document's steps of
each word's largest score in each range of the items pass by the passages whose words together cannot reach the
threshold in any range: WAND's test by block bounds, applied to all passages at once. For the others, block-max WAND retrieves all items above the
threshold, and each is verified: enough five-word shingles of its question and of its answer must be in the passage.

A benchmark of one block (BLOCK_ITEMS, BLOCK_CHARS), as usual, is searched in one pass: its index is sent to the
executors, built once in each worker, and documents are searched in their partitions, without a shuffle. A larger one
is cut into blocks by prefix sums, and each block is a pass of its own over the documents, so that one index is held
at a time; Spark counts the words of all items, and every block is weighed by them. So scores do not depend on blocks.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import broadcast_if_small, extras_apart, materialize, running_sums

K1, B = 1.2, 0.75
#: Of the item's score for its own text.
THRESHOLD = 0.6
SHINGLE = 5
OVERLAP = 0.8
SHORTEST_CLASS = 16
POSTINGS_BLOCK = 64
#: Passages begin so many times in the length of a class.
STEPS = 2
#: Ranges of a class's items whose bounds are summed for all passages at once.
RANGES = 24
#: Items and characters of one block of the benchmark, at most (one item can be larger).
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: A text is gone through so many characters, and so many words, at a time.
PIECE_CHARS, PIECE_WORDS = 1 << 20, 1 << 16
_WORD, _SPACE = re.compile(r"\w+"), re.compile(r"\s")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def token_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[list[str]]:
    """The tokens of a text, some at a time; cut where there is a space, so that no word nor its case changes."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + size) if at + size < len(text) else None
        to = space.start() if space else len(text)
        yield tokens(text[at:to])
        at = to


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of a shorter text, the whole."""
    return {tuple(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))} if found else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all lines but the last with a word, and of that; of one line, its words and none."""
    lines = [x for x in map(tokens, text.split("\n")) if x]
    return [w for x in lines[:-1] or lines for w in x], lines[-1] if len(lines) > 1 else []


class _Class:
    """The inverted index of the items of one length class: for each word its items in order, with their scores."""

    def __init__(self, length: int, postings: dict[int, list[tuple[int, float]]], n_words: int):
        self.length = length
        self.items = {t: [i for i, _ in p] for t, p in postings.items()}
        self.scores = {t: [s for _, s in p] for t, p in postings.items()}
        self.block_max = {t: [max(s[k : k + POSTINGS_BLOCK]) for k in range(0, len(s), POSTINGS_BLOCK)] for t, s in self.scores.items()}
        self.bound = {t: max(m) for t, m in self.block_max.items()}
        # Each word's largest score in each range of the items; the last row is for words of no item.
        order = {i: k for k, i in enumerate(sorted({i for p in self.items.values() for i in p}))}
        self.range_bound = np.zeros((n_words + 1, RANGES), np.float32)
        for t, items in self.items.items():
            for i, x in zip(items, self.scores[t], strict=True):
                at = order[i] * RANGES // len(order)
                self.range_bound[t, at] = max(self.range_bound[t, at], x)

    def search(self, terms: Iterable[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of at least the threshold, by block-max WAND."""
        found: list[tuple[int, float]] = []
        lists = [[t, 0] for t in terms if t in self.items]  # word and place in its list
        item = lambda c: self.items[c[0]][c[1]]
        slack = threshold - 1e-9
        while lists:
            lists.sort(key=item)
            total, pivot = 0.0, -1
            for k, c in enumerate(lists):
                total += self.bound[c[0]]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = item(lists[pivot])
            while pivot + 1 < len(lists) and item(lists[pivot + 1]) == target:
                pivot += 1
            ahead = lists[: pivot + 1]
            if item(lists[0]) < target:
                for c in ahead:
                    c[1] = bisect_left(self.items[c[0]], target, c[1])
            elif sum(self.block_max[t][k // POSTINGS_BLOCK] for t, k in ahead) < slack:
                # No item of these blocks can reach it: on to where the first of them ends, or another list comes in.
                ends = [self.items[t][min(len(self.items[t]), (k // POSTINGS_BLOCK + 1) * POSTINGS_BLOCK) - 1] + 1 for t, k in ahead]
                on = min([*ends, *([item(lists[pivot + 1])] if pivot + 1 < len(lists) else [])])
                for c in ahead:
                    c[1] = bisect_left(self.items[c[0]], on, c[1])
            else:
                score = sum(self.scores[t][k] for t, k in ahead)
                if score >= slack:
                    found.append((target, score))
                for c in ahead:
                    c[1] += 1
            lists = [c for c in lists if c[1] < len(self.items[c[0]])]
        return found


class Statistics(NamedTuple):
    """What BM25 weighs by: in how many items each word is, the items with words, and the words of all of them."""

    frequency: Mapping[str, int]
    items: int
    words: int


def statistics(texts: Iterable[str]) -> Statistics:
    frequency: Counter[str] = Counter()
    items = words = 0
    for found in map(tokens, texts):
        frequency.update(set(found))
        items, words = items + bool(found), words + len(found)
    return Statistics(frequency, items, words)


class Index:
    """All length classes of a block of items (item_id, text), and what verification needs of each. `of` are the
    statistics of the whole benchmark, which the block's own stand for if it is the whole."""

    def __init__(self, items: list[tuple[int, str]], of: Statistics | None = None):
        of = of or statistics(t for _, t in items)
        read = [(i, tokens(t), *question_and_answer(t)) for i, t in items]
        read = [x for x in read if x[1]]
        self.ids = [x[0] for x in read]
        self.parts = [(shingles(q), shingles(a)) for _, _, q, a in read]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for _, found, _, _ in read for w in found))}
        mean = of.words / max(1, of.items)
        by_class: dict[int, dict[int, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, found, _, _) in enumerate(read):
            weights = {w: math.log(1 + (of.items - of.frequency[w] + 0.5) / (of.frequency[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(found) / mean)) for w, n in Counter(found).items()}
            own = sum(weights.values())
            length = max(SHORTEST_CLASS, 1 << (len(found) - 1).bit_length())
            for w, x in weights.items():
                by_class[length][self.number[w]].append((k, x / own))
        self.classes = [_Class(n, p, len(self.number)) for n, p in sorted(by_class.items())]

    def matches(self, text: str, threshold: float, overlap: float, piece: int = PIECE_WORDS) -> list[tuple[int, float, float, float]]:
        """(item_id, score, question overlap, answer overlap) of the items found in the text, each at its best passage.
        The text is gone through in pieces of whole steps of every class, each with the words that its last passages reach."""
        best: dict[int, tuple[float, float, float]] = {}
        if not self.classes:
            return []
        longest = self.classes[-1].length
        piece = -(-piece // (longest // STEPS)) * (longest // STEPS)
        reach = 2 * longest + longest // STEPS
        found: list[str] = []
        for more in token_pieces(text):
            found += more
            while len(found) >= piece + reach:
                self._look(found[: piece + reach], piece, threshold, overlap, best)
                del found[:piece]
        self._look(found, None, threshold, overlap, best)
        return [(self.ids[k], *best[k]) for k in sorted(best)]

    def _look(self, found: list[str], piece: int | None, threshold: float, overlap: float, best: dict[int, tuple[float, float, float]]) -> None:
        """Adds to best what the passages hold that begin in the first `piece` words; None: in all that end a text."""
        get, none = self.number.get, len(self.number)
        ids = np.fromiter(map(get, found, repeat(none)), np.int64, len(found))
        for c in self.classes:
            bounds = c.range_bound[ids]
            step = c.length // STEPS
            starts = np.arange(0, max(1, len(found) - 2 * c.length) if piece is None else piece, step)
            ends = np.minimum(starts + 2 * c.length + step, len(found))
            # Sums over each step, and of the steps of each passage.
            sums = np.zeros((len(starts) + 2 * STEPS, RANGES), np.float32)
            if len(found):
                parts = np.add.reduceat(bounds, np.arange(0, len(found), step), axis=0)
                parts = parts[: len(sums)]
                sums[: len(parts)] = parts
            near = sum(sums[k : k + len(starts)] for k in range(2 * STEPS + 1)).max(axis=1)
            for at in np.flatnonzero(near >= threshold - 1e-4):
                terms = np.unique(ids[starts[at] : ends[at]])
                if c.range_bound[terms].sum(axis=0).max() < threshold - 1e-4:
                    continue
                inside: set[tuple[str, ...]] | None = None
                for k, score in c.search(terms.tolist(), threshold):
                    passage = found[starts[at] : ends[at]]
                    inside = shingles(passage) if inside is None else inside
                    q, a = (_share(x, inside, passage) for x in self.parts[k])
                    if q >= overlap and a >= overlap and (score, q, a) > best.get(k, (0, 0, 0)):
                        best[k] = (score, q, a)


def _share(part: set[tuple[str, ...]], inside: set[tuple[str, ...]], passage: list[str]) -> float:
    """The share of a part's shingles that the passage has; 1 for an empty part."""
    if not part:
        return 1.0
    n = len(next(iter(part)))
    if n < SHINGLE:  # a part of fewer words than a shingle
        inside = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(part & inside) / len(part)


MATCHES = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
#: The index that a worker built last, by the name of its search.
_built: dict[str, Index] = {}


def _index(name: str, sent: Broadcast) -> Index:
    if name not in _built:
        _built.clear()
        _built[name] = Index(*sent.value)
    return _built[name]


def _search(docs: DataFrame, text_col: str, sent: Broadcast, threshold: float, overlap: float) -> DataFrame:
    """docs with `matches` of one block of items."""
    at, names, name = docs.columns.index(text_col), [f.name for f in _KIND.value_type], uuid.uuid4().hex
    out = T.StructType([*docs.schema.fields, T.StructField("matches", docs.sparkSession.createDataFrame([], f"m {MATCHES}").schema[0].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, sent)
        for b in batches:
            rows = [[dict(zip(names, m, strict=True)) for m in index.matches(text.as_py() or "", threshold, overlap)] for text in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _KIND)], names=[*b.schema.names, "matches"])

    return docs.mapInArrow(run, out)


def _item_words(items: DataFrame) -> DataFrame:
    """(block, word, n): each item's different words with n null, and a row without a word with the number of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for block, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = tokens(text)
                rows += [(block, w, None) for w in sorted(set(found))] + [(block, None, len(found))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["block", "word", "n"])

    return items.select("block", "text").mapInArrow(run, "block string, word string, n long")


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], Statistics | None]]:
    """The blocks of a benchmark in order, one in the driver at a time, each with the statistics of all; none if it is all."""
    order = [F.col("item_id").asc_nulls_first(), F.col("text")]
    collected = lambda df: [(r["item_id"], r["text"]) for r in df.orderBy(*order).collect()]
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if n <= BLOCK_ITEMS and chars <= BLOCK_CHARS:
        if n:
            yield collected(items), None
        return
    placed = running_sums(materialize(items, "items"), order, {"_n": F.lit(1), "_chars": F.length("text")})
    block = F.concat_ws("|", F.floor(F.col("_n") / BLOCK_ITEMS), F.floor(F.col("_chars") / BLOCK_CHARS))
    placed = materialize(placed.select("item_id", "text", block.alias("block")), "blocks")
    words = materialize(_item_words(placed), "words")
    frequency = materialize(words.where("word is not null").groupBy("word").agg(F.count("*").alias("items")), "frequency")
    with_words, all_words = words.where("word is null and n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    for (name,) in sorted(map(tuple, placed.select("block").distinct().collect())):
        own = words.where((F.col("block") == name) & F.col("word").isNotNull()).select("word").distinct().join(frequency, "word")
        yield collected(placed.where(F.col("block") == name)), Statistics({r["word"]: r["items"] for r in own.collect()}, with_words, all_words)


@extras_apart("text_col")
def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs with `matches`: the benchmark items (item_id, text) found in each whole text, with their best passage's figures.

    A text that has at least `overlap` of an item's question shingles and of its answer shingles within twice its class's
    length is a match, if it scores, at every place in the text. One that spreads them over more than 2.5
    times that length is not; between the two, the place decides. Null
    texts and texts or items without words match nothing; items of a null id match with a null id (ids are whole numbers, others raise TypeError); repeated items each
    match. BM25's statistics are those of all items. Rows
    stay as they are; other columns pass through, and one named matches gives way. Without items, matches is empty.
    """
    if not isinstance(benchmark.schema["item_id"].dataType, T.IntegralType):
        raise TypeError("item_id must be a whole number")
    rest = docs.drop("matches")
    send = rest.sparkSession.sparkContext.broadcast
    blocks = _blocks(benchmark.select(F.col("item_id").cast("bigint"), "text").where("text is not null"))
    first = next(blocks, None)
    if first is None:
        return rest.withColumn("matches", F.array().cast(MATCHES))
    if first[1] is None:
        return _search(rest, text_col, send(first), threshold, overlap)
    # The rows are written once with a number, so that every pass numbers them alike.
    numbered = materialize(rest.withColumn("_row", F.monotonically_increasing_id()), "documents")
    found = None
    while first:
        sent = send(first)
        part = materialize(_search(numbered.select("_row", text_col), text_col, sent, threshold, overlap).where(F.size("matches") > 0).select("_row", "matches"), "matches")
        sent.destroy()
        found, first = part if found is None else found.union(part), next(blocks, None)
    by_row = broadcast_if_small(materialize(found.groupBy("_row").agg(F.flatten(F.collect_list("matches")).alias("matches")), "matches"))
    return numbered.join(by_row, "_row", "left").select(*rest.columns, F.coalesce("matches", F.array().cast(MATCHES)).alias("matches"))
