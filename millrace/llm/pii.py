"""Personal data: fixed rules for e-mail, IP, card and phone numbers, then bootstrapped contextual extraction.

What the rules find are the seeds, and so are tokens in the format of a key (SECRET). The words around seeds make
lexical patterns: the word before a place, the two before it, those on both its sides. Patterns of enough seeds are
looked for in all texts; a pattern whose places mostly hold something else, as behind an article, is dropped. What words
stand in the places of the others, whatever their form, makes a graph of patterns and words with the seeds. In it a
pattern is as sure as the share of its distinct identifiers, each counted by how sure it is, and a word becomes as sure
as its surest pattern, if most of the places that it has anywhere are such patterns': common words are not identifiers
for standing there once. Found identifiers have patterns of their own, which the next round looks for; rounds end when
none brings a new pattern. Identifiers that no rule knows become spans of kind `id`; a token in the format of a key does
only if it stands in a sure pattern, too.

The main path is DataFrame operations only. A text is searched for patterns and words in place: a place is built and
leaves its row only if the hash of its word before, or of the word itself, is among those looked for. Matches are found
in forms that neither backtrack over long runs nor recurse. Edges are made distinct and counted before any join, and the
joins know hot patterns and hot identifiers.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, extras_apart, is_small, join_unique, materialize, words

#: In the order of spans that begin together. Possessive forms of the plain ones: a match can begin only where a run of
#: its first characters does, or where the last match ended. That of `id` is only for seeds, tokens in the format of a key.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?:\G|(?<![A-Za-z0-9]))[0-9a-f]{32,}+(?![A-Za-z0-9])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: An identifier has so many characters at least, after these around a word are left out.
ID_CHARS, AROUND = 5, "\"'`()[]{}<>,;:!?.*|=#$%&"
#: What seeds for patterns are though no rule makes them spans: long hexadecimal keys.
SECRET = r"^(?=[0-9a-f]*[a-f])[0-9a-f]{32,}$"
#: Rounds, and steps over a round's graph, end by themselves; these bounds raise.
MAX_ROUNDS, MAX_STEPS = 64, 256
#: A sure pattern has so many sure identifiers, summed by how sure they are, and such a share of them.
MIN_SUPPORT, MIN_CONFIDENCE = 5, 0.5
#: Of the places of a pattern's words, so large a share at least holds an identifier that it was made from.
MIN_FILL = 0.1
#: Of the places of an identifier in all texts, so large a share at least is in sure patterns.
MIN_SHARE = 0.5
#: So many words are looked for in place by their hashes, more by a join with all places of the texts; so few, and short
#: ones, by an expression that passes most texts by.
LITERALS, FEW = 10_000, 24
#: Longer patterns and identifiers are known by their MD5.
LONG = 64
_SPACE, _WORD = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"


def _matches(text: Column, kind: str) -> Column:
    """Every match in order: what lies between it and the one before (its length), itself, the patterns of its place."""
    pattern = KINDS[kind]
    # What is written against the match, such as quotes, is no word beside it.
    two = f"^{_WORD}*+{_SPACE}++({_WORD}++)(?:{_SPACE}++({_WORD}++))?"

    def gap(g: Column) -> Column:
        # Whole words at either end, those before by way of the reversed text, so that no search begins in the middle.
        back = F.reverse(g)
        last, last_two = F.reverse(F.regexp_extract(back, two, 1)), F.reverse(F.regexp_extract(back, two, 2))
        return F.struct(F.length(g).alias("n"), last.alias("last"), last_two.alias("last_two"), F.regexp_extract(g, two, 1).alias("after"))

    gaps = F.transform(F.split(text, pattern, -1), gap)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    each = F.zip_with(
        F.slice(F.arrays_zip(gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("next")), 1, F.size(found)),
        found,
        lambda z, m: F.struct(F.lit(kind).alias("kind"), z["g"]["n"].alias("gap"), m.alias("value"), _patterns(z["g"]["last_two"], z["g"]["last"], z["next"]["after"]).alias("patterns")),
    )
    return F.transform(each, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["value"].alias("value"), x["patterns"].alias("patterns")))


def _brief(text: Column) -> Column:
    return F.when(F.length(text) > LONG, F.md5(text)).otherwise(text)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Of up to 19 digits."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(F.transform(each, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(f"^(?:{_BYTE}\\.){{3}}{_BYTE}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(value.rlike(SECRET))
    )


def _plain(word: Column) -> Column:
    """Case and the digits of words do not count."""
    return F.regexp_replace(F.lower(word), "[0-9]+", "0")


def _pattern(kind: str, before: Column, *context: Column) -> Column:
    """A pattern, and the word that stands before its places."""
    return F.struct(_brief(F.concat_ws(" ", F.lit(kind), *context)).alias("pattern"), before.alias("anchor"))


def _patterns(last_two: Column, last: Column, after: Column) -> Column:
    """Lexical patterns of a place: the two words before it, the one before, that with the one after."""
    return _patterns_of(*map(_plain, (last_two, last, after)))


def _patterns_of(two: Column, one: Column, next_one: Column) -> Column:
    known = lambda *c: F.coalesce(functools.reduce(lambda a, b: a & b, [x != "" for x in c]), F.lit(False))
    return F.array_compact(F.array(F.when(known(two, one), _pattern("L2", one, two, one)), F.when(known(one), _pattern("L1", one, one)), F.when(known(one, next_one), _pattern("B", one, one, next_one))))


def _core(word: Column) -> Column:
    return F.btrim(word, F.lit(AROUND))


def _places(texts: DataFrame, behind: list[str] | None = None, among: list[str] | None = None) -> DataFrame:
    """(value, chars, patterns) of the words in texts (text) that stand behind one of the plain words `behind`, or that are
    among some; of all words, if neither is given. Value is the word without what is written around it."""
    if behind is not None or among is not None:
        texts = texts.where(_has(F.col("text"), behind, among))
    text = F.coalesce(F.col("text"), F.lit(""))
    # Digits and case do not move words.
    split = texts.select(words(text).alias("w"), words(_plain(text)).alias("p"))
    at = lambda c, i: F.get(c, i)
    if behind is not None:
        wanted = F.filter(F.transform("p", lambda x, i: F.when(x.isin(behind), i + 1)), lambda i: i.isNotNull() & (i < F.size("w")))
    elif among is not None:
        wanted = F.filter(F.transform("w", lambda x, i: F.when(_core(x).isin(among), i)), lambda i: i.isNotNull())
    else:
        wanted = F.transform("w", lambda x, i: i)
    before = lambda c, i: F.when(i > 0, at(c, i - 1))
    place = lambda i: F.struct(_core(at(F.col("w"), i)).alias("value"), _patterns_of(F.when(i > 1, at(F.col("p"), i - 2)), before(F.col("p"), i), at(F.col("p"), i + 1)).alias("patterns"))
    return split.select(F.explode(F.transform(wanted, place)).alias("x")).select(_brief(F.col("x.value")).alias("value"), F.length("x.value").alias("chars"), "x.patterns")


def _has(text: Column, behind: list[str] | None, among: list[str] | None) -> Column:
    """Whether a text may hold one of few words; true if they are many."""
    wanted = behind if behind is not None else among
    if len(wanted) > FEW:
        return F.lit(True)
    # In plain words a digit stands for any number, and case does not count; others stand as they are.
    quoted = [re.sub("0", "[0-9]++", re.escape(w)) if behind is not None else re.escape(w) for w in wanted]
    around = re.escape(AROUND).replace("/", "\\/")
    return text.rlike(f"(?iu)(?:^|{_SPACE})" + (f"(?:{'|'.join(quoted)})(?:{_SPACE}|$)" if behind is not None else f"[{around}]*+(?:{'|'.join(quoted)})"))


def _listed(df: DataFrame, column: str, most: int) -> list[str] | None:
    """The distinct values of a column, if they are at most so many and none is known by its MD5 only."""
    found = df.select(column).distinct().limit(most + 1).collect()
    return [r[0] for r in found] if len(found) <= most and not any(len(r[0]) > LONG or re.fullmatch("[0-9a-f]{32}", r[0]) for r in found) else None


def _sure(edges: DataFrame, totals: DataFrame, min_support: float, min_confidence: float, min_share: float, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Scores the graph of edges (pattern, value, ruled, seed, chars, n): sure patterns (pattern, sure) and the identifiers
    (value, sure) that they find; totals (value, total): how many places words have anywhere."""
    patterns = materialize(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("n") >= min_support), "patterns")
    free = materialize(join_unique(edges.where(~F.col("ruled") & (F.col("chars") >= ID_CHARS)), patterns.select("pattern"), "pattern", broadcast_rows), "free")
    unknown = free.where("not seed")
    found, before = None, None
    for _ in range(MAX_STEPS):
        known = patterns.withColumn("more", F.lit(0.0))
        if found is not None:
            sums = join_unique(unknown, found, "value", broadcast_rows).groupBy("pattern").agg(F.sum("sure").alias("more"))
            known = patterns.join(sums, "pattern", "left")
        support = F.col("seeds") + F.coalesce("more", F.lit(0.0))
        sure = materialize(known.where((support >= min_support) & (support / F.col("n") >= min_confidence)).select("pattern", (support / F.col("n")).alias("sure")), "sure")
        inside = join_unique(free, sure, "pattern", broadcast_rows).groupBy("value", F.split_part("pattern", F.lit(" "), F.lit(1)).alias("_form")).agg(F.sum("n").alias("n"), F.max("sure").alias("sure"), F.max("seed").alias("seed"))
        # A place has one pattern of each form.
        inside = inside.groupBy("value").agg(F.max("n").alias("n"), F.max("sure").alias("sure"), F.max("seed").alias("seed"))
        shared = inside.join(totals, "value", "left").where(F.col("seed") | (F.col("n") >= min_share * F.coalesce("total", "n")))
        found = materialize(shared.select("value", "sure"), "found")
        now = tuple(found.agg(F.count("*"), F.round(F.sum("sure"), 6)).first())
        if now == before:
            return sure, found
        before = now
    raise RuntimeError(f"scores did not settle in {MAX_STEPS} steps")


def discovered_values(
    mentions: DataFrame,
    texts: DataFrame,
    rounds: int | None = None,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_fill: float = MIN_FILL,
    min_share: float = MIN_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
    literals: int = LITERALS,
) -> DataFrame:
    """(value) of the identifiers that sure patterns find in texts (text). mentions: value, ruled and patterns (array) of
    the seeds; ruled values are not returned, other seeds are if they stand in a sure pattern. rounds: after so many the
    search is broken off; by default it goes on until no round brings a new pattern, and raises beyond MAX_ROUNDS."""
    edges = mentions.select("value", "ruled", F.explode("patterns").alias("p")).groupBy("p.pattern", "value").agg(F.max("ruled").alias("ruled"), F.count("*").alias("n"), F.min("p.anchor").alias("anchor"))
    # What is known of values in patterns: the seeds', and then what stands in the places of patterns that were looked for.
    edges = materialize(edges.select("pattern", "value", "ruled", F.lit(True).alias("seed"), F.lit(ID_CHARS).alias("chars"), "n", "anchor"), "edges")
    seeds = materialize(edges.groupBy("value").agg(F.max("ruled").alias("ruled")), "seeds")
    new = edges.select("pattern", "anchor", "value", F.lit(1.0).alias("sure"), "n")
    looked: DataFrame | None = None
    totals = found = None
    for step in range(MAX_ROUNDS if rounds is None else rounds):
        # Patterns that enough identifiers share, and whose places mostly hold one of them.
        made = new.groupBy("pattern", "anchor").agg(F.sum("sure").alias("support"), F.sum("n").alias("filled")).where(F.col("support") >= min_support)
        if looked is not None:
            made = made.join(looked.select("pattern"), "pattern", "left_anti")
        made = materialize(made, "made")
        if made.isEmpty():
            break
        looked = made.select("pattern") if looked is None else materialize(looked.unionByName(made.select("pattern")), "looked")
        # First in the texts with a digit or an @: a pattern of too many places there has too many in all.
        filled = lambda df, counted: df.join(counted, "pattern", "left").where(F.coalesce("places", F.lit(0)) * min_fill <= F.col("filled")).select(*df.columns)
        places = _places(texts.where(F.col("text").rlike("[0-9@]")), _listed(made, "anchor", literals)).select(F.explode("patterns").alias("p")).select("p.pattern")
        held = materialize(filled(made, _counted(places, made.select("pattern"), broadcast_rows)), "held")
        if held.isEmpty():
            break
        # Then the words in the places of those that are left, in all texts.
        standing = _places(texts, _listed(held, "anchor", literals)).select("value", "chars", F.explode("patterns").alias("p")).select("p.pattern", "p.anchor", "value", "chars")
        standing = _met(standing, held.select("pattern"), "pattern", broadcast_rows)
        standing = materialize(standing.groupBy("pattern", "anchor", "value").agg(F.max("chars").alias("chars"), F.count("*").alias("n")), "standing")
        held = materialize(filled(held, standing.groupBy("pattern").agg(F.sum("n").alias("places"))).select("pattern"), "held")
        if held.isEmpty():
            break
        standing = materialize(standing.join(held, "pattern", "left_semi").join(seeds.select("value"), "value", "left_anti"), "standing")
        more = standing.select("pattern", "value", F.lit(False).alias("ruled"), F.lit(False).alias("seed"), "chars", "n", "anchor")
        kept = edges.join(held.select("pattern"), "pattern", "left_semi") if step == 0 else edges.unionByName(_met(_seed_edges(new, seeds), held.select("pattern"), "pattern", broadcast_rows)).dropDuplicates(["pattern", "value"])
        edges = materialize(kept.unionByName(more).groupBy("pattern", "value").agg(F.max("ruled").alias("ruled"), F.max("seed").alias("seed"), F.max("chars").alias("chars"), F.max("n").alias("n"), F.min("anchor").alias("anchor")), "edges")
        # All places of the words that could be identifiers.
        able = materialize(standing.where(F.col("chars") >= ID_CHARS).select("value").distinct(), "able")
        whole = _places(texts, among=_listed(able, "value", literals))
        whole = materialize(_met(whole.select("value", F.explode_outer("patterns").alias("p")), able, "value", broadcast_rows).groupBy("value", "p.pattern", "p.anchor").agg(F.count("*").alias("n")), "whole")
        fresh = whole.groupBy("value").agg(F.sum(F.when(F.col("pattern").isNull() | F.col("pattern").startswith("L1 "), F.col("n")).otherwise(0)).alias("total"))
        totals = materialize(fresh if totals is None else totals.unionByName(fresh).groupBy("value").agg(F.max("total").alias("total")), "totals")
        sure, found = _sure(edges, totals, min_support, min_confidence, min_share, broadcast_rows)
        new = materialize(whole.where("pattern is not null").join(found, "value").select("pattern", "anchor", "value", "sure", "n").unionByName(new).groupBy("pattern", "anchor", "value").agg(F.max("sure").alias("sure"), F.max("n").alias("n")), "new")
    else:
        if rounds is None:
            raise RuntimeError(f"new patterns after {MAX_ROUNDS} rounds")
    if found is None:
        return seeds.where("false").select("value")
    return found.select("value").join(seeds.where("ruled").select("value"), "value", "left_anti")


def _seed_edges(new: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges of seeds among those of known identifiers."""
    return new.join(seeds, "value").select("pattern", "value", "ruled", F.lit(True).alias("seed"), F.lit(ID_CHARS).alias("chars"), "n", "anchor")


def _met(rows: DataFrame, wanted: DataFrame, key: str, broadcast_rows: int) -> DataFrame:
    """The rows with a key among wanted."""
    return rows.join(F.broadcast(wanted) if is_small(wanted, broadcast_rows) else wanted, key, "left_semi")


def _counted(places: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """(pattern, places) of the wanted patterns; counted before they are shuffled."""
    if is_small(wanted, broadcast_rows):
        return places.join(F.broadcast(wanted), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("places"))
    return places.groupBy("pattern").agg(F.count("*").alias("places")).join(wanted, "pattern", "left_semi")


def _occurrences(docs: DataFrame, values: DataFrame, broadcast_rows: int, literals: int) -> DataFrame:
    """(_t, at) of the texts in docs (text), by their MD5, in which words are, without what is written around them, among
    values: an array of their start and end."""
    text, plain = F.col("text"), docs
    listed = _listed(values, "value", literals)
    if listed is not None:
        plain = plain.where(_has(text, None, listed)).where(F.exists(words(text), lambda x: _core(x).isin(listed)))
    # What lies before each word, and the word.
    gaps = F.split(text, f"{_WORD}++", -1)
    # Numbered before its words are apart.
    rows = plain.select("text", F.md5("text").alias("_t"), F.monotonically_increasing_id().alias("_row"))
    each = rows.select("_t", "_row", F.posexplode(F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(f"{_WORD}++"), F.lit(0)).alias("w"))).alias("i", "x"))
    so_far = F.sum(F.length("x.g") + F.coalesce(F.length("x.w"), F.lit(0))).over(Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("to", so_far.cast("int")).where("x.w is not null")
    # Of the characters around a word, those that stand before it.
    lead = F.length("x.w") - F.length(F.ltrim("x.w", F.lit(AROUND)))
    start = F.col("to") - F.length("x.w") + lead
    of = each.select("_t", _core(F.col("x.w")).alias("value"), start.alias("start")).where(F.length("value") > 0)
    of = of.select("_t", "start", (F.col("start") + F.length("value")).alias("end"), _brief(F.col("value")).alias("value"))
    # Copies of a text have the same.
    return _met(of, values.select("value"), "value", broadcast_rows).groupBy("_t").agg(F.collect_set(F.struct("start", "end")).alias("at"))


@extras_apart("text_col")
def personal_data(
    docs: DataFrame,
    text_col: str = "text",
    rounds: int | None = None,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    broadcast_rows: int = BROADCAST_ROWS,
    literals: int = LITERALS,
    secrets: bool = True,
) -> DataFrame:
    """docs without its text, with `found`: its spans as structs (start, k, end, kind), sorted, code points, end exclusive.

    k is the kind's place among KINDS; kinds before `id` are the rules' spans, which always stay; spans of kind `id`
    overlap none of them. secrets: whether tokens in the format of a key are seeds, too. Null texts count as empty. Each
    row stands for itself, repeated ones too, but an identifier counts once for each pattern, however often it stands
    there. Other columns pass through, and one named found gives way. An empty table gives an empty result. rounds and
    the thresholds: see discovered_values.
    """
    rest = [c for c in docs.columns if c not in (text_col, "found")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = F.when(text.rlike("[0-9@]"), F.concat(*[_matches(text, k) for k in KINDS if secrets or k != "id"]))
    # Rows are numbered once, where they are written; a text is known again by its MD5.
    texts = docs.select(text.alias("text"))
    read = materialize(docs.select(*rest, F.monotonically_increasing_id().alias("_row"), F.md5(text).alias("_t"), may.alias("_m")), "matches")
    each = read.where("_m is not null").select("_row", F.explode("_m").alias("m")).select("_row", "m.*")
    so_far = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("end", so_far.cast("int")).where(_holds(F.col("kind"), F.col("value")))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    spans = placed.select("_row", (F.col("end") - F.length("value")).alias("start"), place.alias("k"), "end", "kind", _brief(F.col("value")).alias("value"), "patterns")
    spans = materialize(spans, "spans")
    ruled = F.col("kind") != "id"
    mentions = spans.select("value", ruled.alias("ruled"), "patterns")
    found = discovered_values(mentions, texts, rounds, min_support, min_confidence, broadcast_rows=broadcast_rows, literals=literals)
    values = materialize(found, "values")
    every = spans.where(ruled).select("_row", "start", "k", "end", "kind")
    if not values.isEmpty():
        # Tokens in the format of a key stand among the matches; of others the places are looked for.
        keys = spans.where(~ruled).join(values, "value", "left_semi").select("_row", "start", "end")
        of_text = materialize(_occurrences(texts, values.join(spans.where(~ruled).select("value"), "value", "left_anti"), broadcast_rows, literals), "occurrences")
        more = join_unique(read.select("_row", "_t"), of_text, "_t", broadcast_rows).select("_row", F.explode("at").alias("s"))
        more = more.select("_row", "s.start", "s.end").unionByName(keys).distinct()
        more = more.select("_row", "start", F.lit(len(KINDS) - 1).alias("k"), "end", F.lit("id").alias("kind"))
        # An identifier is free of the rules' spans if none that begins by its start reaches beyond it and none begins inside.
        both = materialize(every.unionByName(more), "both")
        up = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
        swept = both.withColumns({"_reach": F.max(F.when(ruled, F.col("end"))).over(up), "_next": F.min(F.when(ruled, F.col("start"))).over(down)})
        every = swept.where(ruled | ((F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end"))))).drop("_reach", "_next")
    by_row = every.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "k", "end", "kind"))).alias("found"))
    none = F.array().cast(by_row.schema["found"].dataType)
    return read.select("_row", *rest).join(by_row, "_row", "left").select(*rest, F.coalesce("found", none).alias("found"))


def joined(found: Column) -> Column:
    """`kind:start:end` of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
