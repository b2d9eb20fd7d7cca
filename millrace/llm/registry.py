"""The subpackage's queries, each with production parameters over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, compression_classifier, decontaminate, language_model, mixing, pii, quality_rules, repair, sharding, simhash, spelling, url_filter, warc
from millrace.llm.common import scratch_path, table

#: Labels may be learned from where the CRC of the id's digits, modulo HELD_OUT_OF, is not this remainder.
HELD_OUT, HELD_OUT_OF = 2, 4
#: The language model learns from the documents whose CRC modulo it is not HELD_OUT.
LM_HELD_OUT_OF = 7
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The conversation added to show that control strings in texts survive.
PLANTED = r"\### Assistant: </turn> ok"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled of quality 1 and never 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    ratios = quality_rules.ngram_log_ratios(docs, trusted)
    return quality_rules.quality_rules(docs, ratios).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def held_out(doc_id: str = "doc_id", of: int = HELD_OUT_OF):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of)) == HELD_OUT, F.lit(False))


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_classifier.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return compression_classifier.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    return chat.read_back(chat.format_windows(turns.union(planted)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_archives(manifest, path).drop("url")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rules_frame(spark, URL_RULES)).drop("url")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item found in it."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"] != "id")
    count_of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count_of(k) for k in pii.KINDS if k != "id"]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation that loses all its turns to the damage has zeros, and the digest of no text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.digests(repair.repair(repair.damage(turns))).withColumnRenamed("conv_id", "_c")
    joined = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_katz_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.fit(docs, ~held_out(of=LM_HELD_OUT_OF))
    scored = language_model.score(model)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(model.stats.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.misspelt_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_compression_classifier, op4_chat_windows, op5_warc, op6_url_filter, op7_decontamination, op8_sharding, op9_personal_data, op10_mixing, op11_conversation_repair, op12_katz_model, op13_spelling_variants)
}
_OP5 = """
with d as (select page_id, coalesce(html, '') as payload from pages),
g as (select payload, max(page_id) as of from d group by payload)
select page_id, cast(octet_length(encode(d.payload)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + ((('0x' || substr(sha1(d.payload), cast((i // 4) * 5 + 1 as int), 5))::int >> cast(15 - 5 * (i % 4) as int)) & 31) as int), 1)), '') as payload_digest,
  case when page_id = of then 'response' else 'revisit' end as record_type, case when page_id <> of then of end as refers_to
from d join g on d.payload = g.payload
"""
_OP6 = """
with r(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
f as (select u.page_id, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) as best
  from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by u.page_id)
select u.page_id, u.host, u.path, f.best.rule as rule, coalesce(f.best.verdict, 'allow') as verdict from u left join f using (page_id)
"""
_OP10 = """
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
  md5('millrace-mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as g from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, encode(source)) - 1) % 3 as k from d group by source),
w as (select source, source_size, case k when 0 then 5 when 1 then 2 else 1 end as weight from s),
l as (select *, row_number() over b as pos, (sum(source_size) over ()) - 3 * coalesce(sum(source_size) over (b rows between unbounded preceding and 1 preceding), 0) as rest,
  (sum(weight) over ()) - coalesce(sum(weight) over (b rows between unbounded preceding and 1 preceding), 0) as rest_weight
  from w window b as (order by source_size / weight, source is null, encode(source))),
c as (select pos, rest, rest_weight from l where rest * weight <= 3 * source_size * rest_weight order by pos limit 1),
t as (select source, source_size, case when l.pos < c.pos then (3 * source_size)::double else c.rest::double * weight / c.rest_weight::double end as target from l, c),
e as (select *, case when source_size > 0 then target / source_size else 0.0 end as e from t),
k as (select d.*, case when size > 0 then 4 * (length(bin(size)) - 1) + ((size * 4) >> (length(bin(size)) - 1)) - 3 else 0 end as class from d),
h as (select k.source, k.class, count(*) as n, sum(size)::bigint as words, sum(size::hugeint * size)::double as squares,
  row_number() over (partition by k.source order by k.class desc) as pos from k group by k.source, k.class),
f(source, pos, class, n, words, draws, carry) as (
  select source, 0::bigint, null::bigint, null::bigint, null::bigint, null::bigint, 0.0::double from e
  union all
  select source, pos, class, n, words, draws,
    want - case when words = 0 then 0.0 else draws * mean + (draws / n) * (1 - draws / n) * (squares / mean - words) end
  from (select *, case when words = 0 then 0 else least(n, greatest(0, floor(want / mean + 0.5)))::bigint end as draws
    from (select h.*, h.words / h.n as mean, (e.e - floor(e.e)) * h.words + f.carry as want
      from f join h on f.source is not distinct from h.source and h.pos = f.pos + 1 join e on e.source is not distinct from h.source) x) y),
p as (select k.*, (('0x' || substr(g, 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u, draws, draws / n as m,
  draws / n + draws / n * (1 - draws / n) * (k.size / (words / n) - 1) as p from k join f on k.source is not distinct from f.source and k.class = f.class),
o as (select *, row_number() over (partition by source, class order by case when m > 0 and m < 1 then (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) end, g) as place from p)
select doc_id, size, source_size, target, ((floor(e) + case when place <= draws then 1 else 0 end) * size)::bigint as taken from o join e on o.source is not distinct from e.source
"""
#: tab: what the CRC-32 of each byte is, so that the CRC of a list of bytes is a fold.
_CRC = """t as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)) x)"""


def _crc(text: str) -> str:
    h = f"hex(encode({text}))"
    parsed = f"list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, cast(2 * i + 1 as int), 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {parsed}), lambda c, b: xor(c >> 8, tab[cast((xor(c, b) & 255) + 1 as int)])), 4294967295)"


_OP11 = f"""
with recursive {_CRC},
o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, t),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from o, range(2) r(k) where kind <> 0 and (k = 0 or kind = 3)),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, left(role, 1) as i from d),
m as (select *, row_number() over (partition by conv_id, role, text order by pos) as again from n),
f as (select *, case when bare = '' then 'blank' when again > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
  lag(i) over (partition by conv_id order by pos) as before from m),
g as (select *, case when fault in ('blank', 'duplicate') then 1000000 when fault = 'truncated' then 3 else 0 end as stay from f),
c as (select conv_id, count(*) as size, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal from g group by conv_id),
v(conv_id, pos, v0, v1, v2, v3) as (
  select conv_id, size, 0, 6, 3, 0 from c
  union all
  select conv_id, pos, least(b0, 3 + least(b2, 3 + b3)), least(b1, 3 + least(b2, 3 + b3)), least(b2, 3 + b3), least(b3, 3 + b2) from (
    select g.conv_id, g.pos,
      least(4 + v0, stay + case i when 's' then v1 when 'u' then v2 else 1000000 end, 3 + stay + v2) as b0, least(4 + v1, stay + case i when 'u' then v2 else 1000000 end, 3 + stay + v2) as b1,
      least(4 + v2, stay + case i when 'a' then v3 else 1000000 end, 3 + stay + v3) as b2, least(4 + v3, stay + case i when 'u' then v2 else 1000000 end, 3 + stay + v2) as b3
    from v join g on g.conv_id is not distinct from v.conv_id and g.pos = v.pos - 1) x),
a as (select v.conv_id, v.pos, [v0, v1, v2, v3] as costs, g.i, g.stay, g.role, g.text from v left join g on g.conv_id is not distinct from v.conv_id and g.pos = v.pos),
w(conv_id, pos, s, audit, lines) as (
  select conv_id, 0::bigint, 0, '', []::varchar[] from c
  union all
  select conv_id, case when e = 'I' then pos else pos + 1 end, case e when 'D' then s when 'K' then kept else next end, audit || e,
    case e when 'D' then lines when 'I' then list_append(lines, who || ':') when 'K' then list_append(lines, role || ':' || text) else list_append(lines, who || ':' || text) end
  from (select *, case when s = 2 then 'assistant' else 'user' end as who,
      case when after is not null and here[s + 1] = 4 + after[s + 1] then 'D' when here[s + 1] = 3 + here[next + 1] then 'I' when here[s + 1] = stay + after[kept + 1] then 'K' else 'R' end as e
    from (select w.*, a.costs as here, z.costs as after, a.i, a.stay, a.role, a.text, case when s = 2 then 3 else 2 end as next,
        case when a.i = 's' and s = 0 then 1 when a.i = 'u' and s <> 2 then 2 when a.i = 'a' and s = 2 then 3 end as kept
      from w join a on a.conv_id is not distinct from w.conv_id and a.pos = w.pos left join a z on z.conv_id is not distinct from w.conv_id and z.pos = w.pos + 1
      where not (z.pos is null and s in (0, 3))) x) y),
e as (select w.conv_id, audit, sha256(array_to_string(lines, chr(10))) as repaired_sha256 from w join c on c.conv_id is not distinct from w.conv_id and w.pos = size where s in (0, 3))
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(v0, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i left join c on c.conv_id is not distinct from i.conv_id left join e on e.conv_id is not distinct from i.conv_id left join v on v.conv_id is not distinct from i.conv_id and v.pos = 0
"""
_OP13 = f"""
with recursive {_CRC},
r as (select doc_id, run, count(*) as n from (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents) x
  where length(run) >= 6 group by doc_id, run),
h as (select run, n, {_crc("coalesce(doc_id::varchar, '') || ':' || run")} as h from r, t),
w as (select word, sum(n)::bigint as n from (select n, case when h % 199 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) + 2 as int)) else run end as word from h) x
  where length(word) >= 6 group by word having sum(n) >= 5),
x as (select word, n, i, left(word, cast(i as int)) || substr(word, cast(i + 2 as int)) as rest from (select word, n, unnest(range(length(word))) as i from w) y),
p as (select a.word, a.n, b.word as near, b.n as m from x a join x b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select x.word, x.n, w.word, w.n from x join w on x.rest = w.word union select w.word, w.n, x.word, x.n from x join w on x.rest = w.word),
f as (select word, count(*) as n_near, first(near order by m desc, near) as near, max(m) as m, any_value(n) as n from p group by word),
g as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when f.m >= 5 * w.n then f.near end as form, case when f.m >= 5 * w.n then f.m end as form_n from w left join f on f.word = w.word),
c(word, root) as (select word, word from g union all select c.word, g.form from c join g on g.word = c.root where g.form is not null)
select g.word, g.form, c.root, g.n::bigint as n, g.n_near::bigint as n_near, g.form_n::bigint as form_n from g join c on c.word = g.word join g e on e.word = c.root and e.form is null
"""
ORACLE_SQL: dict[str, str] = {"op11_conversation_repair": _OP11, "op13_spelling_variants": _OP13, "op5_warc": _OP5, "op6_url_filter": _OP6, "op10_mixing": _OP10}
