"""The opN_ queries: each operator over its whole table with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_extract, jaccard_join, langid, minhash, packing, pii, sharding, spelling, spotsigs, url_reputation, warc

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled when the number that ends its path is that of a labelled document; it is good if of quality and not toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"/(\d{1,18})(?:\.html)?/?$", 1).try_cast("long")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    outcomes = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", (F.col("good") == 1).alias("good"))
    return url_reputation.judge_urls(pages, outcomes, url_reputation.rules_frame(spark, RULES))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("virtual").alias("virtual_slot"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out).select("lang", "text"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints_with_next(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(_table(spark, sf_dir, "documents"), one_in=199))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of operator 10 over length partitions, beside its fingerprints."""
    return spotsigs.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_jaccard_join, op3_decontamination, op4_html_extraction, op5_personal_data, op6_sharding, op7_language_id, op8_packing, op9_warc, op10_spotsigs, op11_minhash, op12_spelling_variants, op13_hard_negatives, spotsigs_near_duplicates)}

_RULES_SQL = ", ".join(f"('{a}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}')" for a, r in RULES)
_SUFFIX, _ADDRESS = url_reputation.LONG_SUFFIX, url_reputation.ADDRESS


def _strength(of: str, mean: str) -> str:
    s, r = f"sum(pow(k - n * {mean}, 2) - n * {mean} * (1 - {mean}))", f"sum(n * (n - 1) * {mean} * (1 - {mean}))"
    return f"(select round(1 / (case when {r} <> 0 then least(greatest({s} / {r}, 1e-3), 0.5) else 1e-3 end) - 1, 6) from {of})"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ANCHORS = ", ".join(f"'{w}'" for w in sorted(set(spotsigs.ANCHORS)))


def _spots_sql(of: str, text: str) -> str:
    """(doc_id, sigs) of the texts in a table: words with their rank among the content words, then the chain after each anchor."""
    return f"""
  with w as (
    select doc_id, string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') as words from {of}),
  u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from w),
  c as (select *, lag(word in ({_ANCHORS}), 1, false) over (partition by doc_id order by place) as spot from u),
  k as (select doc_id, spot, word || ' ' || lead(word) over (partition by doc_id order by place) as chain from c where word not in ({_ANCHORS})),
  f as (select doc_id, list_sort(list(distinct left(md5(chain), 16))) as sigs from k where spot and chain is not null group by 1)
  select doc_id, coalesce(sigs, [left(md5('=' || array_to_string(words, ' ')), 16)]) as sigs from w left join f using (doc_id)"""


def _likeness_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"{both}::double / (len({a}) + len({b}) - {both})"


_REACHED = "case when doc_id is not null then coalesce(component_id, doc_id) end"


def _jaccard_sql(k: int, percent: int) -> str:
    """d (doc_id, members): sets of shingles; least_of (members, component_id)."""
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as words from documents),
d as (
  select doc_id, case when len(words) = 0 then [] when len(words) < {k} then [array_to_string(words, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')))) end as members
  from w),
s as (select members, min(doc_id) as a, len(members) as n from d where len(members) > 0 and doc_id is not null group by 1),
p as (select a, n, unnest(members) as shingle from s),
shared as (select x.a, y.a as b, x.n as na, y.n as nb, count(*) as both_have from p x join p y using (shingle) where x.a < y.a group by all),
l as (select a, b from shared where 100 * both_have >= {percent} * (na + nb - both_have)),
e as (from l union all select b, a from l),
r as (select a, a as b from s union select r.a, e.b from r join e on r.b = e.a),
least_of as (select members, min(r.b) as component_id from s join r using (a) group by 1)"""


# One step of a CRC-32 is a table entry; the table follows from its polynomial.
_CRC = """crc_table as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from (select unnest(range(256)) as i)))"""

ORACLE = {
    "op1_url_filter": rf"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
l as (select doc_id, min((quality = 1 and toxic = 0)::int) as good from labels group by 1 having good is not null),
o as (select page_id, min(good) as good from (select page_id, try_cast(regexp_extract(path, '/(\d{{1,18}})(?:\.html)?/?$', 1) as bigint) as doc_id from p) join l using (doc_id) where page_id is not null group by 1),
h0 as (select host, count(good) as n, coalesce(sum(good), 0)::bigint as k, regexp_replace(host, ':\d+$', '') as plain from p left join o using (page_id) group by 1),
h1 as (select *, case when regexp_matches(plain, '^({_ADDRESS})$') then plain when regexp_matches(plain, '(^|\.)({_SUFFIX})$') then regexp_extract(plain, '(?:^|\.)({_SUFFIX})$', 1) else regexp_extract(plain, '[^.:]*$') end as suffix from h0),
h as (select *, case when length(plain) - length(suffix) - 1 <= 0 then plain else regexp_extract(left(plain, length(plain) - length(suffix) - 1), '[^.]*$') || '.' || suffix end as domain from h1),
a as (select (sum(k) + 1)::double / (sum(n) + 2) as m from h),
s0 as (select suffix, sum(n)::double as n, sum(k)::double as k, (select m from a) as m from h group by 1),
s1 as (select {_strength('s0', 'm')} as c),
s as (select suffix, (k + c * m) / (n + c) as sm from s0, s1),
d0 as (select domain, suffix, sum(n)::double as n, sum(k)::double as k from h group by 1, 2),
d1 as (select d0.*, sm from d0 join s using (suffix)),
d2 as (select {_strength('d1', 'sm')} as c),
d as (select domain, (k + c * sm) / (n + c) as dm from d1, d2),
e0 as (select host, n::double as n, k::double as k, dm from h join d using (domain)),
e1 as (select {_strength('e0', 'dm')} as c),
e2 as (select host, n, (k + c * dm) / (n + c) as mean, n + c + 1 as mass from e0, e1),
e as (select host, n::bigint as n_labelled, round(greatest(0.0, mean - 1.645e0 * sqrt(mean * (1 - mean) / mass)), 6) as bound from e2),
r as (select * from (values {_RULES_SQL}) as v(action, rule_host, rule_path, rule)),
hp as (select distinct host, path from p),
f as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
      from hp join r on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by 1, 2)
select page_id, p.host, p.path, f.rule, coalesce(f.action, case when bound >= 0.5 then 'allow' else 'block' end) as verdict, n_labelled, bound
from p join e using (host) left join f on f.host = p.host and f.path = p.path""",
    "op2_jaccard_join": f"""{_jaccard_sql(4, 85)}
select doc_id, len(d.members)::bigint as n_shingles, {_REACHED} as component_id
from d left join least_of using (members)""",
    "op11_minhash": f"""{_jaccard_sql(2, 80)}
select doc_id, len(d.members)::bigint as n_shingles, {_REACHED} as component_id, doc_id = {_REACHED} as kept
from d left join least_of using (members)""",
    "op10_spotsigs": f"""
with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from documents),
ordered as (
  select *, coalesce(lag(text) over o, last_value(text) over (o rows between unbounded preceding and unbounded following)) as next,
         coalesce(lag(doc_id) over o, last_value(doc_id) over (o rows between unbounded preceding and unbounded following)) as next_id
  from t window o as (order by doc_id)),
e as (select *, left(text, n_chars - n_chars // 2) || left(next, n_chars // 2) as edited from ordered),
a as ({_spots_sql("e", "text")}),
b as ({_spots_sql("e", "edited")})
select e.doc_id, e.n_chars::bigint as n_chars, sha256(edited) as edited_sha256, array_to_string(a.sigs, ',') as fingerprint, array_to_string(b.sigs, ',') as edited_fingerprint,
       {_likeness_sql("a.sigs", "b.sigs")} as near_edited, {_likeness_sql("a.sigs", "m.sigs")} as near_next
from e join a using (doc_id) join b using (doc_id) join a m on m.doc_id = e.next_id""",
    "spotsigs_near_duplicates": f"""
with recursive e as (select doc_id, coalesce(text, '') as text from documents),
f as ({_spots_sql("e", "text")}),
s as (select sigs, min(doc_id) as a, len(sigs) as n from f group by 1),
p as (select a, n, unnest(sigs) as sig from s),
shared as (select x.a, y.a as b, x.n as na, y.n as nb, count(*) as both_have from p x join p y using (sig) where x.a < y.a group by all),
l as (select a, b from shared where both_have::double / (na + nb - both_have) >= 0.8e0),
t as (from l union all select b, a from l),
r as (select a, a as b from s union select r.a, t.b from r join t on r.b = t.a),
least_of as (select sigs, min(r.b) as component_id from s join r using (a) group by 1)
select doc_id, len(f.sigs)::bigint as n_signatures, component_id from f join least_of using (sigs)""",
    "op12_spelling_variants": f"""
with recursive {_CRC},
o as (select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
g as (select doc_id, run, count(*) as n from o where length(run) >= 6 group by 1, 2),
b as (select *, list_transform(list_filter(string_split(hex(encode(doc_id::varchar || ':' || run)), ''), lambda x: x <> ''), lambda x: strpos('0123456789ABCDEF', x) - 1) as half from g),
h as (select run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(half) + 1, 2), lambda i: half[i] * 16 + half[i + 1])), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) as h from b, crc_table),
w as (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
v as (select word, sum(n)::bigint as n from w where length(word) >= 6 group by 1 having sum(n) >= 5),
cut as (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from v)),
near as (select distinct x.word, y.word as other, y.n as other_n from cut x join cut y using (i, rest) where x.word <> y.word
  union select distinct cut.word, v.word, v.n from cut join v on v.word = cut.rest union select distinct v.word, cut.word, cut.n from cut join v on v.word = cut.rest),
best as (select word, count(*) as n_near, max(other_n) as top from near group by 1),
named as (select word, min(other) as form from near join best using (word) where other_n = top group by 1),
f as (select v.word, case when top >= 5 * n then form end as form, n, coalesce(n_near, 0) as n_near, case when top >= 5 * n then top end as form_n from v left join best using (word) left join named using (word)),
r as (select word, word as root, form from f union all select r.word, f.word, f.form from r join f on f.word = r.form)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join r using (word) where r.form is null""",
    "op13_hard_negatives": """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where label = anchor_label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over w as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where label <> anchor_label and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify rank <= 5""",
    "op9_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
r as (select payload_digest, max(page_id) as last from p where payload_bytes >= 1000 group by 1 having count(*) > 1)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when last is not null and page_id is distinct from last then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from last then last end as refers_to
from p left join r using (payload_digest)""",
}
