"""Spelling variants by rolling-hash deletions.

Two words differ by one replaced code point just if they are alike without it, and by one inserted if one of them is
the other without it. The hash of a word without a code point comes from polynomial hashes of its prefix and its suffix,
for all places of all words of a batch in a few NumPy steps, in time and memory of their length. Keys are dealt by their
high bits and sorted; words that meet under a key are compared as strings before they count.

No pairs are made. Words alike but for one place are as many as there are letters, or take a row each; a group is passed
over once, and each of its words learns how many the others are and which is the most frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Of words with more code points, the deletions carry an MD5; the word itself is fetched for those that meet.
LONG = 64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
#: Code points that a task hashes at once.
BLOCK = 1 << 20
#: The steps from a word over its forms to the root are doubled in each round.
MAX_ROUNDS = 40
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(text: Column, least: int = 1) -> Column:
    """The maximal runs of letters A to Z and U+00C0 to U+00FF with so many code points at least, A to Z lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(lower, F.lit(f"{RUN}{{{least},}}+"), F.lit(0))


def misspelt_words(docs: DataFrame, least: int = MIN_CHARS, every: int = 199) -> DataFrame:
    """(word) of every run of letters in docs (doc_id, text) of `least` code points or more after misspelling: where
    `every` divides h, the CRC of `doc_id:run`, the run lacks its code point h modulo its length. A null text has none, a
    null doc_id counts as an empty one; rows stand for themselves. Other columns are left out."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_i"), F.explode(runs(F.col("text"), least)).alias("_r"))
    h = F.crc32(F.concat("_i", F.lit(":"), "_r").cast("binary"))
    at = F.pmod(F.col("_h"), F.length("_r")).cast("int")
    lacking = F.concat(F.substring("_r", F.lit(1), at), F.substring("_r", at + 2, F.length("_r")))
    return run.withColumn("_h", h).select(F.when(F.col("_h") % every == 0, lacking).otherwise(F.col("_r")).alias("word")).where(F.length("word") >= least)


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words one after the other: the length of each, the hash of it without each of its code points, and its own."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    powers = np.empty(int(sizes.max(initial=0)) + 1, np.uint64)
    powers[0], powers[1:] = 1, np.uint64(_BASE)
    powers = np.cumprod(powers, dtype=np.uint64)
    # All arithmetic is modulo 2^64, so sums over the whole batch give those within a word by subtraction.
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[place], dtype=np.uint64)])
    begin = np.repeat(upto[starts], sizes)
    whole = upto[starts + sizes] - upto[starts]
    prefix = upto[:-1] - begin
    suffix = np.repeat(whole, sizes) - (upto[1:] - begin)
    return sizes, prefix + suffix * np.uint64(_INVERSE), whole


def _mixed(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key from a hash and a length, all bits of which depend on all of theirs."""
    x = h ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    at, total = 0, 0
    for k, n in enumerate(sizes):
        total += int(n)
        if k > at and total > BLOCK:
            yield slice(at, k)
            at, total = k, int(n)
    if at < len(sizes):
        yield slice(at, len(sizes))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word a row for itself (at -1) and for each code point that it may lack: key, at, the word or, if what is
    left is long, its MD5, whether it is one, and the word's count."""
    names = ["key", "at", "word", "brief", "n"]
    for b in batches:
        words, counts, digests = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_pylist()
        for part in _parts(np.array([len(w) for w in words])):
            own = words[part]
            sizes, less, whole = _hashes(own)
            of = np.concatenate([np.arange(len(own)), np.repeat(np.arange(len(own)), sizes)])
            at = np.concatenate([np.full(len(own), -1), np.arange(len(less)) - np.repeat(np.cumsum(sizes) - sizes, sizes)])
            left = np.where(at < 0, sizes[of], sizes[of] - 1)
            keys = _mixed(np.concatenate([whole, less]), left).view(np.int64)
            brief = left > LONG
            plain, short = pa.array(own, pa.string()), pa.array(digests[part], pa.string())
            for rows in (~brief, brief):
                index = np.flatnonzero(rows)
                for k in range(0, len(index), 100_000):
                    i = index[k : k + 100_000]
                    told = (short if rows is brief else plain).take(pa.array(of[i]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(at[i].astype(np.int32)), told, pa.array(brief[i]), pa.array(counts[part][of[i]])], names=names)


def _told(key: np.ndarray, at: np.ndarray, word: list[str], n: np.ndarray, ratio: int) -> tuple[list, list, list, list]:
    """What each of the rows of whole keys, sorted by key and place, learns: word, near words, the best form and its count."""
    more = np.concatenate([[False], key[1:] == key[:-1], [False]])
    met = np.flatnonzero(more[1:] | more[:-1])
    if not len(met):
        return [], [], [], []
    key, at, n, word = key[met], at[met], n[met], [word[i] for i in met]
    left = [w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(word, at.tolist(), strict=True)]
    same_key = np.concatenate([[False], key[1:] == key[:-1]])
    alike = np.array([False, *[a == b for a, b in zip(left[1:], left, strict=False)]])
    if (same_key & ~alike).any():  # a collision: by string
        order = sorted(range(len(left)), key=lambda i: (key[i], left[i], at[i]))
        key, at, n = key[order], at[order], n[order]
        word, left = [word[i] for i in order], [left[i] for i in order]
        same_key = np.concatenate([[False], key[1:] == key[:-1]])
        alike = np.array([False, *[a == b for a, b in zip(left[1:], left, strict=False)]])
    new = ~(same_key & alike)
    place = new | np.concatenate([[True], at[1:] != at[:-1]])
    near, best = np.zeros(len(key), np.int64), np.full(len(key), -1)

    def top(rows: np.ndarray) -> int:
        most = n[rows].max()
        return min((i for i in rows if n[i] == most), key=lambda i: word[i])

    # Words alike but for what stands at one place.
    starts = np.flatnonzero(place)
    ends = np.append(starts[1:], len(key))
    for s, e in zip(starts, ends, strict=True):
        if e - s > 1:
            near[s:e] += e - s - 1
            best[s:e] = top(np.arange(s, e))
    # The word itself, and those that have a code point more; of equal neighbours the first stands for all.
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(key))
    for s, e in zip(starts, ends, strict=True):
        if at[s] < 0 and e - s > 1:
            longer = np.array([i for i in range(s + 1, e) if at[i] == 0 or word[i][at[i]] != word[i][at[i] - 1]])
            near[s] += len(longer)
            best[s] = top(longer)
            near[longer] += 1
            other = best[longer]
            better = (other < 0) | (n[s] > n[other]) | ((n[s] == n[other]) & np.array([o < 0 or word[s] < word[o] for o in other]))
            best[longer] = np.where(better, s, other)
    rows = np.flatnonzero(near)
    form = [int(best[i]) if best[i] >= 0 and n[best[i]] >= ratio * n[i] else None for i in rows]
    return [word[i] for i in rows], near[rows].tolist(), [None if f is None else word[f] for f in form], [None if f is None else int(n[f]) for f in form]


def _groups(entries: DataFrame, ratio: int) -> DataFrame:
    """(word, near, form, form_n) of entries (key, at, word, n), whose words are whole. Several rows for a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def batch(rows: tuple) -> pa.RecordBatch:
            found = _told(*rows, ratio)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "form", "form_n"])

        for b in batches:
            if not b.num_rows:
                continue
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), b.column(3).to_numpy())
            if held is not None:
                now = (*[np.concatenate([x, y]) for x, y in zip(held[:2], now[:2], strict=True)], held[2] + now[2], np.concatenate([held[3], now[3]]))
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            if cut:
                yield batch(tuple(x[:cut] for x in now))
            held = tuple(x[cut:] for x in now)
        if held is not None:
            yield batch(held)

    radix = F.shiftrightunsigned("key", 44)
    dealt = entries.select("key", "at", "word", "n").repartition(radix).sortWithinPartitions("key", "at", "word")
    return dealt.mapInArrow(run, "word string, near long, form string, form_n long")


def near_words(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """counted (word, n), words distinct, with n_near, how many of its words differ from it by one inserted, deleted or
    replaced code point, and form, the most frequent of them, the smallest in code-point order of equal ones, if it is
    `ratio` times as frequent as the word at least, else null; form_n is its n. counted is a written table."""
    entries = materialize(counted.select("word", "n", F.md5("word").alias("_md5")).mapInArrow(_entries, "key long, at int, word string, brief boolean, n long"), "deletions")
    plain = entries.where("not brief").select("key", "at", "word", "n")
    briefs = entries.where("brief")
    if not briefs.isEmpty():
        # Of long words only those deletions are made of which two have a key; keys have a row each at most.
        met = briefs.groupBy("key").agg(F.count("*").alias("_k")).where("_k > 1").select("key")
        found = briefs.join(met, "key", "left_semi").withColumnRenamed("word", "_md5")
        words = counted.where(F.length("word") >= LONG).select(F.md5("word").alias("_md5"), "word")
        plain = plain.unionByName(found.join(words, "_md5").select("key", "at", "word", "n"))
    told = _groups(plain, ratio)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    of = told.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_b"))
    joined = counted.join(of, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("_b.form").alias("form"), (-F.col("_b.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words in formed (word, form) that have a form: the word that the forms of forms end in. Each
    round doubles the steps that a word has gone. Raises RuntimeError if MAX_ROUNDS do not end it: forms in a circle."""
    links = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "links")
    for _ in range(MAX_ROUNDS):
        onward = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        joined = links.join(onward, F.col("root") == F.col("_w"), "left")
        stepped = materialize(joined.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_went")), "links")
        links = stepped.select("word", "root")
        if stepped.where("_went").isEmpty():
            return links
    raise RuntimeError(f"forms did not end in {MAX_ROUNDS} rounds")


def group_variants(words: DataFrame, least_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """Of the distinct values of words (word; one row per occurrence) with least_count occurrences or more: word, form,
    root, n, n_near, form_n. See near_words for form, and roots for root, which is the word itself where it has no form.
    Null words and other columns are left out; an empty word is one like any other. No rows give none."""
    counted = words.where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    formed = materialize(near_words(materialize(counted, "words"), ratio), "formed")
    ended = roots(formed).withColumnRenamed("word", "_w")
    out = formed.join(ended, F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
