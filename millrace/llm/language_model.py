"""Katz backoff: a bigram model over unigrams, fitted on some documents and asked for all of them.

Counts are discounted by Good and Turing's estimate up to MAX_DISCOUNTED. What the discounts leave of a history goes to the
words that never followed it, in proportion to their unigram probabilities, by a weight that makes the history's
probabilities sum to one; the unigrams' own rest is the probability of an unknown word. A history all of whose counts
are beyond discounting is counted as once more than it occurs, which leaves that one.

Texts are read once. A block of tokens becomes sorted arrays of its distinct bigrams, each with its count and the rows
that it stands in, dealt by the word into parts; a part is written once, with all that the corpus holds of its words.
Everything else is passes over parts: counts of counts, sums by history, then scores, of which a row gets a sum from each
part. Only what an unseen bigram is backed off by is fetched by its history. Words that many tokens are, as a sample
tells, are dealt by bigram instead, so that no part holds them alone; their counts are put together. What is sampled
decides where a word is counted, never what.

Tokens are known by their 64-bit XXH64; two that share one would be one word.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import broadcast_if_small, join_unique, materialize

#: A text's end counts as a token, its beginning only as the first one's history. Words are neither empty nor a space.
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")
#: Counts up to it are discounted, as by Katz.
MAX_DISCOUNTED = 5
#: Tokens of a block; bytes of text of a part, of which there are MIN_PARTS at least.
BLOCK, PART_BYTES, MIN_PARTS = 3 << 19, 6 << 20, 8
#: Documents of a block.
BLOCK_DOCS = 1 << 16
#: Places of a part that are scored at once; sums by row that a task holds.
SEGMENT, HELD_SUMS = 1 << 17, 1 << 19
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: One in so many documents tells which words are frequent: those with over a quarter of a part's share of tokens.
SAMPLE, HOT_PARTS = 32, 4
_ROWS = 20_000
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Shuffle files go with the job that made them, not with the driver's next collection of garbage; texts come in few
#: at a time, next to the block that is gathered of them.
_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def _written(df: DataFrame, name: str) -> DataFrame:
    """materialize, with little in memory and no shuffles left on disk."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            conf.set(k, v)
        return materialize(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _give_back() -> None:
    """Returns to the system what a worker has freed: a worker outlives its task, and the C library keeps freed arrays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def _pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, A to Z lower-cased, a piece of about so many bytes at a time."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + size) if at + size < len(text) else None
        to = gap.start() if gap else len(text)
        yield text[at:to].lower().split()
        at = to


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _pack(x: np.ndarray) -> bytes:
    """An array of whole numbers; equal bytes of its numbers lie together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _part(word: np.ndarray, history: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    dealt = np.where(np.isin(word, hot), word ^ (history * _ODD), word) if len(hot) else word
    return np.mod(dealt.view(np.int64), parts).astype(np.int32)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _runs(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


class _Blocks:
    """Gathers tokens with their histories and rows; gives blocks as rows of BLOCKS."""

    def __init__(self, parts: int, hot: np.ndarray, kind: pa.DataType, names: list[str]) -> None:
        self.parts, self.hot, self.kind, self.names = parts, hot, kind, names
        self.clear()

    def clear(self) -> None:
        self.word, self.history, self.row, self.docs, self.tokens = [], [], [], [], 0

    def add(self, word: np.ndarray, history: np.ndarray, row: int, learn: bool) -> None:
        self.word.append(word)
        self.history.append(history)
        self.row.append(np.full(len(word), 2 * row + learn, np.int64))
        self.tokens += len(word)

    def rows(self) -> pa.RecordBatch:
        (word, history, row), docs = (np.concatenate(x) for x in (self.word, self.history, self.row)), self.docs
        self.clear()
        base = int(row[0]) >> 1
        part = _part(word, history, self.hot, self.parts)
        order = np.lexsort((history, word, part))
        word = word[order]
        history = history[order]
        row = row[order]
        part = part[order]
        del order
        firsts = _starts(part)
        out: list[list] = [[] for _ in range(7)]
        held = base % self.parts
        present = part[firsts].tolist()
        spans = dict(zip(present, zip(firsts.tolist(), [*firsts[1:].tolist(), len(part)], strict=True), strict=True))
        for p in sorted({*present, held}):
            a, b = spans.get(p, (0, 0))
            w, h, r = word[a:b], history[a:b], row[a:b]
            gram = _starts(w, h) if b > a else np.empty(0, np.int64)
            seen = _runs(gram, b - a)
            learned = np.add.reduceat(r & 1, gram) if len(gram) else np.empty(0, np.int64)
            arrays = (w[gram], h[gram], seen.astype(np.uint32), learned.astype(np.uint32), ((r >> 1) - base).astype(np.uint32))
            packed = [_pack(x) for x in arrays]
            own = docs if p == held else []
            for column, x in zip(out, (p, base, packed, *[[d[k] for d in own] for k in range(4)]), strict=True):
                column.append(x)
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(self.kind), pa.list_(pa.bool_()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=self.names)


def _blocks(docs: DataFrame, parts: int, hot: np.ndarray, block: int) -> DataFrame:
    """docs (id, text as bytes, learn) as rows of part, base, arrays and the lists row, id, learn, n of documents."""
    kind = docs.schema[0].dataType
    schema = T.StructType.fromDDL("part int, base long, arrays array<binary>").add("row", T.ArrayType(T.LongType())).add("id", T.ArrayType(kind)).add("learn", T.ArrayType(T.BooleanType())).add("n", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        held: _Blocks | None = None
        for b in batches:
            if held is None:
                held = _Blocks(parts, hot, b.schema.field(0).type, schema.names)
            for k in range(b.num_rows):
                text, learn = b.column(1)[k].as_py() or b"", bool(b.column(2)[k].as_py())
                before, n = np.array([START], np.uint64), 0
                for words in (*_pieces(text), None):
                    token = np.array([END], np.uint64) if words is None else _hashed(words)
                    if len(token):
                        held.add(token, np.concatenate([before, token[:-1]]), row, learn)
                        before, n = token[-1:], n + len(token)
                    if words is None:
                        held.docs.append((row, b.column(0)[k].as_py(), learn, n))
                    if held.tokens >= block or len(held.docs) >= BLOCK_DOCS:
                        yield held.rows()
                        _give_back()
                row += 1
        if held is not None and held.tokens:
            yield held.rows()
        _give_back()

    return docs.mapInArrow(run, schema)


#: words, bigrams of each, their histories, how often learned and how often seen, and the rows of those places.
_ARRAYS = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.int64)


def _gathered(blocks: DataFrame, hot: np.ndarray, most: int) -> DataFrame:
    """A row for each part: its arrays (see _ARRAYS), the documents that came with it, and of its words and bigrams the
    number learned 1, 2 ... most times; words and learned are the sums over the words that are not hot, hot_n of the
    others by their place in hot."""
    schema = T.StructType.fromDDL("part int, words binary, grams binary, histories binary, learned binary, seen binary, rows binary")
    for f in blocks.schema[3:]:
        schema.add(f.name, f.dataType)
    for name in ("word_counts", "gram_counts", "sums", "hot_n"):
        schema.add(name, T.ArrayType(T.LongType()))

    def run(table: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32)
        every: list[list[np.ndarray]] = [[] for _ in kinds]
        for base, arrays in zip(table.column("base").to_pylist(), table.column("arrays"), strict=True):
            for k, (x, kind) in enumerate(zip(arrays, kinds, strict=True)):
                data = _unpack(x.as_py(), kind)
                every[k].append(data.astype(np.int64) + base if k == 4 else data)
        # One at a time, so that little stands in memory twice.
        word, history, seen, learned, rows = (np.concatenate(every.pop(0)) for _ in kinds)
        order = np.lexsort((history, word))
        word = word[order]
        history = history[order]
        learned = learned[order].astype(np.int64)
        # Places move with their bigram.
        begins = (np.cumsum(seen, dtype=np.int64) - seen)[order]
        size = seen[order].astype(np.int64)
        moved = np.repeat(begins - (np.cumsum(size) - size), size)
        del order, begins, seen
        moved += np.arange(len(moved))
        rows = rows[moved]
        del moved
        gram = _starts(word, history) if len(word) else np.empty(0, np.int64)
        add = lambda x, at: np.add.reduceat(x, at) if len(at) else np.empty(0, np.int64)
        seen, learned, word, history = add(size, gram), add(learned, gram), word[gram], history[gram]
        first = _starts(word) if len(word) else np.empty(0, np.int64)
        own, of = word[first], add(learned, first)
        is_hot = np.isin(own, hot)
        cold = of[~is_hot]
        hot_n = np.zeros(len(hot), np.int64)
        hot_n[np.searchsorted(hot, own[is_hot])] = of[is_hot]
        count = lambda x: np.bincount(x[(x > 0) & (x <= most)], minlength=most + 1)[1:].tolist()
        packed = [_pack(x.astype(k)) for x, k in zip((own, _runs(first, len(word)), history, learned, seen, rows), _ARRAYS, strict=True)]
        lists = [[x for part in table.column(n).to_pylist() for x in part] for n in ("row", "id", "learn", "n")]
        values = [table.column("part")[0].as_py(), *packed, *lists, count(cold), count(learned), [int((cold > 0).sum()), int(learned.sum())], hot_n.tolist() if hot_n.any() else []]
        del word, history, learned, seen, rows, own, of
        _give_back()
        types = [pa.int32(), *[pa.binary()] * 6, *[table.schema.field(n).type for n in ("row", "id", "learn", "n")], *[pa.list_(pa.int64())] * 4]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=schema.names)

    return blocks.groupBy("part").applyInArrow(run, schema)


def discounts(counts: list[int]) -> list[float]:
    """counts: how many are counted once, twice and so on. Katz's discount ratios by count, for one count less; in case
    of counts too few or odd for them, for as many as give ratios between 0 and 1; if none do, of half a count each."""
    for k in range(len(counts) - 1, 0, -1):
        if min(counts[: k + 1]) < 1:
            continue
        common = (k + 1) * counts[k] / counts[0]
        if common == 1:
            continue
        found = [((r + 1) * counts[r] / (r * counts[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return found
    return [(r - 0.5) / r for r in range(1, len(counts))]


@dataclass
class Statistics:
    """What the tables sum to. hot and hot_n: the words dealt by bigram, sorted, and their counts."""

    n_parts: int
    hot: np.ndarray
    hot_n: np.ndarray
    tokens: int
    words: int
    of_words: list[float]
    of_grams: list[float]
    lost: float

    def kept(self, n: np.ndarray, ratios: list[float]) -> np.ndarray:
        """Counts after discounting."""
        table = np.array([1.0, *ratios])
        return n * np.where(n < len(table), table[np.minimum(n, len(table) - 1)], 1.0)

    def unigram(self, n: np.ndarray) -> np.ndarray:
        """The probability of words by their counts; of count 0, of all unknown words together."""
        total = self.tokens if self.lost > 0 else self.tokens + 1
        return np.where(n > 0, self.kept(n, self.of_words), self.lost or 1.0) / (total or 1)

    def word_counts(self, words: np.ndarray, grams: np.ndarray, learned: np.ndarray) -> np.ndarray:
        """Of the words of a part, over the whole corpus."""
        out = np.add.reduceat(learned, np.cumsum(grams, dtype=np.int64) - grams) if len(words) else np.empty(0, np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            out = np.where(self.hot[at] == words, self.hot_n[at], out)
        return out


@dataclass
class Model:
    """Written tables and their sums. parts: see _gathered. backoffs: history, total, lost (what the discounts take of its
    counts) and seen (the unigram probability of the words that follow it)."""

    stats: Statistics
    parts: DataFrame
    backoffs: DataFrame


def _denominator(total: int, lost: float) -> int:
    return total if lost > 0 else total + 1


def _weight(total: int, lost: float, seen: float) -> float:
    """The backoff weight of a history."""
    return (lost if lost > 0 else 1.0) / _denominator(total, lost) / (1 - seen)


def _hot_words(docs: DataFrame, parts: int) -> np.ndarray:
    """Words, sorted, that over a quarter of a part's share of tokens is in a sample of the documents: 4 a part at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.full(b.num_rows, END, np.uint64)]
            for text in b.column(0):
                tokens += [_hashed(words) for words in _pieces(text.as_py() or b"")]
            word, n = np.unique(np.concatenate(tokens), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    sample = docs.select(docs.columns[1]).where(F.pmod(F.xxhash64(docs.columns[1]), F.lit(SAMPLE)) == 0)
    counted = sample.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") * (HOT_PARTS * parts) > total).select("word").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", max_discounted: int = MAX_DISCOUNTED, block: int = BLOCK, part_bytes: int = PART_BYTES, hot: list[int] | None = None) -> Model:
    """The model of those of docs for which learn is true; all of docs are in its tables, to be scored. A null text is
    empty, and so holds its end only; rows stand for themselves; other columns are left out. hot overrides the sample."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_parts = max(MIN_PARTS, math.ceil(size / part_bytes))
    frequent = _hot_words(plain, n_parts) if hot is None else np.sort(np.array(hot, np.uint64))
    parts = _written(_gathered(_blocks(plain, n_parts, frequent, block), frequent, max_discounted + 1), "parts")
    sums = lambda name, k: [int(x or 0) for x in parts.agg(*[F.sum(F.get(name, F.lit(i))) for i in range(k)]).first()]
    hot_n = np.zeros(len(frequent), np.int64)
    for r in parts.select(F.posexplode("hot_n").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        hot_n[r.k] = r.n
    most = max_discounted + 1
    word_counts, gram_counts, (n_cold, tokens) = sums("word_counts", most), sums("gram_counts", most), sums("sums", 2)
    word_counts = [n + int((hot_n == k + 1).sum()) for k, n in enumerate(word_counts)]
    of_words = discounts(word_counts)
    lost = sum(n * (r + 1) * (1 - of_words[r]) for r, n in enumerate(word_counts[: len(of_words)]))
    stats = Statistics(n_parts, frequent, hot_n, tokens, n_cold + int((hot_n > 0).sum()), of_words, discounts(gram_counts), lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, grams, histories, learned = (_unpack(b.column(c)[k].as_py(), kind) for c, kind in enumerate(_ARRAYS[:4]))
                n = learned.astype(np.int64)
                p = np.repeat(stats.unigram(stats.word_counts(words, grams, n)), grams)
                known = np.flatnonzero(n)
                known = known[np.argsort(histories[known], kind="stable")]
                if not len(known):
                    continue
                at = _starts(histories[known])
                sums = [np.add.reduceat(x[known], at) for x in (n, n - stats.kept(n, stats.of_grams), p)]
                for i in range(0, len(at), _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(histories[known][at].view(np.int64)[i : i + _ROWS]), *[pa.array(x[i : i + _ROWS]) for x in sums]], names=["history", "total", "lost", "seen"])
            _give_back()

    each = parts.select("words", "grams", "histories", "learned").mapInArrow(run, "history long, total long, lost double, seen double")
    backoffs = _written(each.groupBy("history").agg(*[F.sum(c).alias(c) for c in ("total", "lost", "seen")]), "backoffs")
    return Model(stats, parts, backoffs)


class _RowSums:
    """Sums by row of what a task reads, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, rows: np.ndarray, times: np.ndarray, values: tuple[np.ndarray, ...]) -> None:
        """rows: those of all bigrams, one after the other, so many times each; values: one for each bigram."""
        own, index = np.unique(rows, return_inverse=True)
        self.parts.append((own, *[np.bincount(index, np.repeat(x, times), len(own)) for x in values]))
        self.size += len(own)

    def merge(self) -> None:
        rows = np.concatenate([p[0] for p in self.parts])
        own, index = np.unique(rows, return_inverse=True)
        self.parts = [(own, *[np.bincount(index, np.concatenate([p[k] for p in self.parts]), len(own)) for k in (1, 2, 3)])]
        self.size = len(own)

    def take(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 4
        self.merge()
        (own, known, base, p), self.parts, self.size = self.parts[0], [], 0
        return own, np.round(known).astype(np.int64), base, p


def score(model: Model, broadcast_rows: int = 100_000) -> DataFrame:
    """A row for each document: id, learn, n_tokens (its end is one), n_known of them, base_score, the sum of
    log10((n + 1) / (tokens + words + 1)) over tokens by their counts n, and score, the model's log10 probability of the
    text. An unknown word has the probability of all unknown words together. No rows give none."""
    unlike, stats = F.col("lost") <= 0, model.stats
    flags = model.backoffs.where(unlike).groupBy(F.pmod("history", F.lit(stats.n_parts)).cast("int").alias("part")).agg(F.collect_list("history").alias("undiscounted"))
    flags = broadcast_if_small(materialize(flags, "undiscounted"))
    start = model.backoffs.where(F.col("history") == int(np.uint64(START).view(np.int64))).select("total", "lost", "seen").first()
    first = (-math.log10(_denominator(start.total, start.lost)), math.log10(_weight(*start))) if start else (0.0, 0.0)
    # Frequent words are in parts of other numbers.
    hot_flags: set[int] = set()
    if len(stats.hot):
        hot = model.backoffs.sparkSession.createDataFrame([(int(x),) for x in stats.hot.view(np.int64)], "history long")
        hot_flags = {r[0] for r in model.backoffs.where(unlike).join(F.broadcast(hot), "history", "left_semi").select("history").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "known", "base", "score", "history"]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        sums = _RowSums()

        def told(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(found[0]), _ROWS):
                part = [pa.array(x[i : i + _ROWS], t) for x, t in zip(found, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), pa.int64())], names=names)

        for b in batches:
            for k in range(b.num_rows):
                words, grams, histories, learned, seen, rows = (_unpack(b.column(c)[k].as_py(), kind) for c, kind in enumerate(_ARRAYS))
                counts = stats.word_counts(words, grams, learned.astype(np.int64))
                flagged = np.array([*(b.column(6)[k].as_py() or []), *hot_flags], np.int64).view(np.uint64)
                ahead = np.where((words != END) & (counts > 0), np.log10(np.maximum(1, counts + np.isin(words, flagged))), 0.0)
                by_word = (counts > 0, np.log10(counts + 1.0), np.log10(stats.unigram(counts)), ahead)
                word = np.repeat(np.arange(len(words), dtype=np.int32), grams)
                ends = np.cumsum(seen, dtype=np.int64)
                cuts = np.append(np.flatnonzero(np.diff(ends // SEGMENT)) + 1, len(seen)) if len(seen) else []
                first_gram = 0
                for last in cuts:
                    at = slice(first_gram, int(last))
                    row = rows[ends[at][0] - seen[at][0] : ends[at][-1]]
                    known, base, alone, less = (x[word[at]] for x in by_word)
                    n, opens, times = learned[at].astype(np.int64), histories[at] == START, seen[at]
                    p = np.where(n > 0, np.log10(np.maximum(stats.kept(n, stats.of_grams), 1e-300)) + opens * first[0], alone + opens * first[1]) - less
                    sums.add(row, times, (known, base, p))
                    # What these are backed off by is known by their history.
                    unseen = (n == 0) & ~opens
                    back, history = row[np.repeat(unseen, times)], np.repeat(histories[at][unseen], times[unseen]).view(np.int64)
                    for i in range(0, len(back), _ROWS):
                        x = back[i : i + _ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array(x), *[pa.nulls(len(x), t) for t in kinds[1:4]], pa.array(history[i : i + _ROWS])], names=names)
                    first_gram = int(last)
                    if sums.size > HELD_SUMS:
                        sums.merge()
                        if 4 * sums.size > 3 * HELD_SUMS:
                            yield from told(sums.take())
            _give_back()
        yield from told(sums.take())
        _give_back()

    arrays = ["words", "grams", "histories", "learned", "seen", "rows"]
    dealt = model.parts.select("part", *arrays).join(flags, "part", "left").select(*arrays, "undiscounted")
    told = _written(dealt.mapInArrow(run, "row long, known long, base double, score double, history long"), "told")
    back = told.where("history is not null").select("row", "history")
    # The weight, with the denominator that has been taken for a seen word given back.
    weight = F.log10(F.when(unlike, 1.0).otherwise(F.col("lost"))) - F.log10(1 - F.col("seen"))
    weights = materialize(model.backoffs.select("history", weight.alias("weight")), "weights")
    backed = join_unique(back, weights, "history", broadcast_rows).select("row", F.lit(None).cast("long").alias("known"), F.lit(None).cast("double").alias("base"), F.col("weight").alias("score"))
    by_row = told.where("history is null").select("row", "known", "base", "score").unionByName(backed).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "score")])
    docs = model.parts.select(F.explode(F.arrays_zip("row", "id", "learn", "n")).alias("d")).select("d.*")
    per_token = math.log10(stats.tokens + stats.words + 1)
    return docs.join(by_row, "row").select("id", "learn", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), (F.col("base") - F.col("n") * per_token).alias("base_score"), "score")
