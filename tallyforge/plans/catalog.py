"""All queries of the library by name, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, corpus, facts, restore, store
from ..sources import corpus_tables as src

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return put


def _corpus(select: str) -> str:
    joint = "," if select.startswith("pub ") else ""
    return f"with {src.CORPUS_SQL.strip()}{joint} {select}"


def _facts(select: str) -> str:
    return f"with {src.FACTS_SQL.strip()}, {select}"


_PUB = "pub as (select * from manifest where origin = 'public_original')"
_NORM = "case when path like '../%' then 'corpus/' || substr(path, 4) else 'corpus/files/' || path end"
_STATUS = f"""{_PUB}, classified as (
  select p.*, case when p.path like '../%' then 'rejected_path' when s.sha256 = p.sha256 then 'current' when l.sha256 is null then 'not_landed' when l.sha256 <> p.sha256 then 'mismatch' when s.sha256 is null then 'new' else 'replaced' end as status
  from pub p left join store s using (path) left join landed l using (path))"""


def _public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.origin_filter(src.manifest(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.classify(_public(spark, sf_dir), src.store(spark, sf_dir), src.landed(spark, sf_dir))


@query(_corpus("select id, origin, path, url, sha256 from manifest"))
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = src.scratch(spark, "manifest")
    src.manifest(spark, sf_dir).select("id", "origin", "path", "url", "sha256").write.json(path)
    return src.manifest_scan(spark, path, multi_line=False)


@query(_corpus(f"{_PUB} select id, path, sha256 from pub"))
def origin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(spark, sf_dir).select("id", "path", "sha256")


@query(_corpus(f"{_PUB} select id, {_NORM} as norm_path from pub"))
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.normalize_path(_public(spark, sf_dir)).select("id", "norm_path")


@query(_corpus(f"{_PUB} select id, path from pub where path like '../%'"))
def reject_escaping_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.reject_escaping_paths(_public(spark, sf_dir))[1].select("id", "path")


@query("select doc_id, sha256(text) as sha256 from documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.fingerprint(src.table(spark, sf_dir, "documents"), "text").select("doc_id", "sha256")


@query(_corpus(f"{_PUB} select p.id, case when s.sha256 is null then 'absent' when s.sha256 = p.sha256 then 'current' else 'stale' end as state from pub p left join store s using (path)"))
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.freshness(_public(spark, sf_dir), src.store(spark, sf_dir)).select("id", "state")


@query(_corpus(f"{_PUB} select id, path from pub p where not exists (select 1 from store s where s.path = p.path and s.sha256 = p.sha256)"))
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pending(_public(spark, sf_dir), src.store(spark, sf_dir)).select("id", "path")


@query(_corpus(f"{_STATUS} select id, path, status from classified"))
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("id", "path", "status")


@query(_corpus(f"""{_STATUS}, fresh as (select distinct path from classified where status in ('new', 'replaced'))
select path, sha256, octet_length(encode(content)) as bytes from (select path, sha256, content from store where path not in (from fresh) union all select path, sha256, content from landed where path in (from fresh))"""))
def verified_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with its contents, then what was landed brought in as a second version; read back as files."""
    base, _ = _restored(spark, sf_dir)
    return store.read_store(spark, base).select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def _restored(spark: SparkSession, sf_dir: str) -> tuple[str, restore.Run]:
    """The store of an earlier run, and the run that restores from it what was landed: its failures are expected here."""
    base = src.scratch(spark, "store")
    files = src.store_files(spark, sf_dir)
    store.update_store(corpus.fingerprint(files, "content").select("path", "sha256"), files, base)
    try:
        run = restore.restore(src.manifest(spark, sf_dir), src.landed_files(spark, sf_dir), base, src.scratch(spark, "sinks"))
    except restore.RunFailed as failed:
        run = failed.run
    return base, run


_AFTER = f"""{_STATUS}, fresh as (select distinct path, sha256 from classified where status in ('new', 'replaced')),
after as (select path, sha256 from store where path not in (select path from fresh) union all select path, sha256 from fresh),
sizes as (select sha256, any_value(octet_length(encode(content)))::bigint as bytes from (select sha256, content from store union all select sha256, content from landed) group by 1)"""


@query(_corpus(f"""{_AFTER}
select 1 as version, (select count(*) from store) as n_paths, count(*) as n_contents, count(*) as n_new, coalesce(sum(bytes), 0)::bigint as bytes_new from sizes where sha256 in (select sha256 from store)
union all select 2, (select count(*) from after), (select count(distinct sha256) from after), count(*), coalesce(sum(bytes), 0)::bigint from sizes where sha256 in (select sha256 from fresh) and sha256 not in (select sha256 from store)"""))
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two versions of verified_replace point to, and the contents that each brought."""
    return store.store_history(spark, _restored(spark, sf_dir)[0])


@query(_corpus(f"""{_AFTER}
select 'store' as sink, path as key, sha256 as value from after
union all select 'dead_letters', id, status || ': ' || path from classified where status in ('rejected_path', 'not_landed', 'mismatch')
union all select 'outcome', status, count(*)::varchar from classified group by status"""))
def restore_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sinks of one run, as they are after it has raised."""
    base, run = _restored(spark, sf_dir)
    held = store.read_pointers(spark, base, run.version).select(F.lit("store").alias("sink"), F.col("path").alias("key"), F.col("sha256").alias("value"))
    letters = spark.read.parquet(f"{run.folder}/dead_letters").select(F.lit("dead_letters"), "id", "error")
    return held.union(letters).union(spark.read.parquet(f"{run.folder}/outcome").select(F.lit("outcome"), "status", F.col("n").cast("string")))


@query(_corpus(f"{_STATUS} select id, status || ': ' || path as error from classified where status in ('rejected_path', 'not_landed', 'mismatch')"))
def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dead_letter(_classified(spark, sf_dir))


@query(_corpus(f"{_STATUS} select status, count(*) as n from classified group by status"))
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run_outcome(_classified(spark, sf_dir))


@query(_facts("""need as (select document, name, period from facts where period not like '%Q%'), have as (select document, name, period from facts where period not like '%Q%' and substr(document, 2)::bigint % 7 <> 0)
select n.document as "group", count(h.name) = count(*) as ready, coalesce(string_agg(n.name || '/' || n.period, ',' order by n.name || '/' || n.period) filter (where h.name is null), '') as missing
from need n left join have h using (document, name, period) group by 1"""))
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required: every annual fact of an entity; present: those of entities that were delivered."""
    annual = src.stored(src.facts(spark, sf_dir).where("period not like '%Q%'").select(F.col("document").alias("group"), F.concat_ws("/", "name", "period").alias("path")), "annual")
    present = annual.where("cast(substring(`group`, 2) as bigint) % 7 <> 0")
    return corpus.completeness(annual, present).select("group", "ready", F.array_join("missing_paths", ",").alias("missing"))


@query(_facts("d as (select * from facts) select document, name, value, unit, period, page, sha256(document) as pdf_sha256, 'https://example.org/' || document as url from d"))
def fact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are written as nested files of one document each and read back flat."""
    path = src.scratch(spark, "facts")
    rows = src.facts(spark, sf_dir).groupBy("document").agg(F.collect_list(F.struct("document", "name", "value", "unit", "period", "page")).alias("upstream_reference"))
    nested = rows.select(F.lit("facts").alias("description"), F.sha2("document", 256).alias("pdf_sha256"), F.concat(F.lit("https://example.org/"), "document").alias("url"), "upstream_reference")
    nested.write.json(path, compression="gzip")
    return src.fact_scan(spark, path, multi_line=False)


def _faulty(select: str) -> str:
    return f"with {src.FAULTY_SQL.strip()}, parsed as (select *, try_cast(value as decimal(24,4)) as amount, try_cast(regexp_extract(period, '^(\\d{{4}})(-Q[1-4])?$', 1) as int) as year, try_cast(regexp_extract(period, '^\\d{{4}}-Q([1-4])$', 1) as int) as quarter from faulty){'' if select.startswith(',') else ' '}{select}"


@query(_faulty("select document, name, period, amount, amount is not null as ok from parsed"))
def parse_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.parse_value(src.faulty_facts(spark, sf_dir)).select("document", "name", "period", "amount", "ok")


@query(_faulty("select document, name, period, year, quarter, case when year is null then null when quarter is null then 'annual' else 'quarter' end as grain, coalesce(4 * year + quarter, year) as period_index from parsed"))
def parse_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.parse_period(src.faulty_facts(spark, sf_dir)).select("document", "name", "period", "year", "quarter", "grain", "period_index")


_UNREAD = "unread as (select *, concat_ws(',', case when amount is null then 'value' end, case when year is null then 'period' end) as reason from parsed where amount is null or year is null)"
_LETTER = "document || '/' || name || '/' || period as id, 'unreadable ' || concat_ws(', ', case when amount is null then 'value ' || value end, case when year is null then 'period ' || period end) as error"


@query(_faulty(f", {_UNREAD} select document, name, value, period, reason from unread"))
def fact_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that cannot be read, each once with its reason."""
    return facts.read_facts(src.faulty_facts(spark, sf_dir))[1].select("document", "name", "value", "period", "reason")


_FILES = """files as (select document, substr(document, 2)::bigint % 10 as k, count(*) as n, sha256(document) as digest from facts group by 1),
broken as (select sha256('{"description":"facts","pdf_sha256":"' || digest || '","upstream_reference":[{"document":"' || document) as cut from files where k = 3)"""


def _fact_files(spark: SparkSession, rows: DataFrame) -> str:
    """The facts as lines of JSON, a document each; some are cut off, some without facts."""
    path = src.scratch(spark, "facts")
    docs = rows.groupBy("document").agg(F.collect_list(F.struct("document", "name", "value", "unit", "period", "page")).alias("list"))
    head = F.concat(F.lit('{"description":"facts","pdf_sha256":"'), F.sha2("document", 256), F.lit('","upstream_reference":'))
    k = F.expr("cast(substring(document, 2) as bigint) % 10")
    line = F.when(k == 3, F.concat(head, F.lit('[{"document":"'), "document")).when(k == 5, F.concat(head, F.lit("[]}"))).otherwise(F.concat(head, F.to_json("list"), F.lit("}")))
    docs.select(line.alias("value")).write.text(path, compression="gzip")
    return path


@query(_facts(f"""{_FILES} select 'read' as reason, digest as pdf_sha256, n, null::varchar as record_sha256 from files where k not in (3, 5)
union all select 'no_facts', digest, 0, null from files where k = 5 union all select 'unreadable', null, 0, cut from broken"""))
def fact_file_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact files: those read with the number of their facts, and each broken one once with its reason."""
    flat, broken = src.read_fact_files(spark, _fact_files(spark, src.facts(spark, sf_dir)), multi_line=False)
    read = flat.groupBy("pdf_sha256").agg(F.count("*").alias("n")).select(F.lit("read").alias("reason"), "pdf_sha256", "n", F.lit(None).cast("string").alias("record_sha256"))
    return read.union(broken.select("reason", "pdf_sha256", F.lit(0).cast("long"), F.sha2("record", 256)))


@query(_faulty(f""", {_UNREAD}, kept as (select *, substr(document, 2)::bigint % 10 as k from faulty), files as (select distinct document, k from kept)
select 'outcome' as sink, 'read' as key, count(*)::varchar as value from parsed where amount is not null and year is not null and substr(document, 2)::bigint % 10 not in (3, 5)
union all select 'outcome', 'unreadable ' || reason, count(*)::varchar from unread where substr(document, 2)::bigint % 10 not in (3, 5) group by reason
union all select 'outcome', case k when 3 then 'unreadable' else 'no_facts' end, count(*)::varchar from files where k in (3, 5) group by k
union all select 'dead_letters', id, error from (select document, {_LETTER} from unread) where substr(document, 2)::bigint % 10 not in (3, 5)
union all select 'dead_letters', 'file', case k when 3 then 'unreadable: no digest' else 'no_facts: ' || sha256(document) end from files where k in (3, 5)"""))
def fact_load_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sinks of one load of faulty facts in files of which some are broken, as they are after it has raised."""
    path = _fact_files(spark, src.faulty_facts(spark, sf_dir))
    try:
        run = restore.load_facts(spark, path, src.scratch(spark, "loaded"), src.scratch(spark, "sinks"), multi_line=False)
    except restore.RunFailed as failed:
        run = failed.run
    letters = spark.read.parquet(f"{run.folder}/dead_letters")
    named = F.when(F.col("id").contains("/part-"), "file").otherwise(F.col("id"))
    outcome = spark.read.parquet(f"{run.folder}/outcome").select(F.lit("outcome").alias("sink"), F.col("status").alias("key"), F.col("n").cast("string").alias("value"))
    return outcome.union(letters.select(F.lit("dead_letters"), named, "error"))


@query(_faulty("select name, string_agg(distinct unit, ',' order by unit) as units from parsed group by name having count(distinct unit) > 1 or count(*) filter (where unit not in ('元', '%', '元/股')) > 0"))
def unit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.unit_consistency(src.faulty_facts(spark, sf_dir))


@query(_faulty("select document, name, period, count(*) as n, count(distinct amount) as n_amounts, case when count(distinct amount) > 1 then 'conflict' else 'duplicate' end as kind from parsed where amount is not null and year is not null group by 1, 2, 3 having count(*) > 1"))
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fact_conflicts(facts.parsed(src.faulty_facts(spark, sf_dir)))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts, parsed and still dealt by document; a query that uses them several times stores what it needs of them."""
    return facts.parsed(src.facts(spark, sf_dir))


@query(_facts("w as (select 'S' || e as document, y::varchar as period, revenue, net_profit_parent, net_profit_parent_adjusted, operating_cash_flow, assets_total, equity_parent, eps_basic from yf) select * from w"))
def pivot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.pivot_facts(_clean(spark, sf_dir).where("grain = 'annual'"), (*src.AMOUNTS, "assets_total", "equity_parent", "eps_basic"))


@query(_facts("u as (select document, name, period, value::decimal(24,4) as value from facts where period not like '%Q%') select * from u"))
def unpivot_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual statements with a column for every year there is, back to a row a period."""
    annual = src.stored(_clean(spark, sf_dir).where("grain = 'annual'").select("document", "name", "period", "amount"), "annual")
    years = sorted(r["period"] for r in annual.select("period").distinct().collect())
    wide = annual.groupBy("document", "name").pivot("period", years).agg(F.first("amount"))
    return facts.unpivot_statement(wide, ["document", "name"], years)


_PARSED = "f as (select *, value::decimal(24,4) as amount, substr(period, 1, 4)::int as year, try_cast(substr(period, 7) as int) as quarter from facts)"
_ROLLUP = f"""{_PARSED}, ru as (select document, name, year, cast(sum(amount) filter (where quarter is not null) as decimal(24,4)) as sum_q, count(distinct quarter) as n_q, max(amount) filter (where quarter is null) as annual
 from f where name in ('revenue', 'net_profit_parent', 'net_profit_parent_adjusted', 'operating_cash_flow') group by 1, 2, 3),
 rollup_ as (select *, case when n_q = 4 then cast(sum_q - annual as decimal(24,4)) end as diff, case when n_q < 4 then 'incomplete' when annual is null then 'no_annual' when abs(sum_q - annual) > 0 then 'mismatch' else 'ok' end as status from ru)"""


@query(_facts(f"{_ROLLUP} select document, name, year, sum_q, n_q, annual, diff, status from rollup_"))
def quarter_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.quarter_rollup(_clean(spark, sf_dir))


@query(_facts("m as (select 'S' || s_suppkey as document, sha256(s_name) as sha256, 'https://example.org/' || s_suppkey as url from supplier where s_suppkey % 9 <> 0) select f.document, name, period, value, sha256, url from facts f join m using (document)"))
def trace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.trace_source(src.facts(spark, sf_dir), _suppliers(spark, sf_dir))[0].select("document", "name", "period", "value", "sha256", "url")


@query(_facts("o as (select document, name, period from facts where substr(document, 2)::bigint % 9 = 0) select * from o"))
def orphan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.trace_source(src.facts(spark, sf_dir), _suppliers(spark, sf_dir))[1].select("document", "name", "period")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.table(spark, sf_dir, "supplier").where("s_suppkey % 9 <> 0")
    return rows.select(F.expr("concat('S', s_suppkey)").alias("id"), F.sha2("s_name", 256).alias("sha256"), F.expr("concat('https://example.org/', s_suppkey)").alias("url"))


_VERIFY = """a as (select document, case when substr(document, 2)::bigint % 5 = 0 and name = 'assets_total' and period = '1998' then null else name end as name, period, value::decimal(24,4) as want, unit, page as want_page from facts), e0 as (select *, substr(document, 2)::bigint as e from a),
x as (select document, name, period, cast(case when e % 13 = 0 then want + 1 else want end as decimal(24,4)) as got, case when e % 29 = 0 then '%' else unit end as unit, case when e % 7 = 0 then 2 else want_page end as got_page from e0 where e % 17 <> 0
 union all select 'S' || (100000 + e), name, period, want, unit, want_page from e0 where e % 19 = 0),
v as (select coalesce(x.document, a.document) as document, coalesce(x.name, a.name) as name, coalesce(x.period, a.period) as period, got, want, got_page, want_page,
 case when x.document is null then 'missing' when a.document is null then 'unexpected' when x.unit is distinct from a.unit then 'unit_mismatch' when abs(got - want) <= 0 then 'match' else 'mismatch' end as status
 from x full join a on x.document = a.document and x.name is not distinct from a.name and x.period = a.period)"""


@query(_facts(f"{_VERIFY} select * from v"))
def verify_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts as extracted with known errors, some without a name, against the answers."""
    e = F.expr("cast(substring(document, 2) as bigint)")
    answers = facts.parse_value(src.facts(spark, sf_dir)).withColumn("name", F.when((e % 5 == 0) & (F.col("name") == "assets_total") & (F.col("period") == "1998"), None).otherwise(F.col("name")))
    answers = src.stored(answers, "answers")
    shifted = answers.where(e % 17 != 0).withColumn("amount", F.when(e % 13 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(24,4)")).withColumn("unit", F.when(e % 29 == 0, "%").otherwise(F.col("unit"))).withColumn("page", F.when(e % 7 == 0, 2).otherwise(F.col("page")))
    copies = answers.where(e % 19 == 0).withColumn("document", F.concat(F.lit("S"), (e + 100000).cast("string")))
    return facts.verify_facts(shifted.unionByName(copies), answers)


@query("""with s as (select source as kind, case when doc_id % 3 = 0 then 'b' else 'a' end as split, quality = 1 as ok from labels join documents using (doc_id)),
g as (select kind, split, count(*) as n, sum(ok::int)::bigint as passed from s group by 1, 2), h as (select *, passed::double / n as p, n::double as m from g)
select kind, split, n, passed, round(p, 6) as rate,
 round(least(greatest((p + 3.8416e0 / (2 * m) - 1.96e0 * sqrt(p * (1 - p) / m + 3.8416e0 / (4 * m * m))) / (1 + 3.8416e0 / m), 0e0), 1e0), 6) as lo,
 round(least(greatest((p + 3.8416e0 / (2 * m) + 1.96e0 * sqrt(p * (1 - p) / m + 3.8416e0 / (4 * m * m))) / (1 + 3.8416e0 / m), 0e0), 1e0), 6) as hi from h""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = src.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind"), F.expr("if(doc_id % 3 = 0, 'b', 'a')").alias("split"))
    return facts.scorecard(src.table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("passed", F.col("quality") == 1))


def _groups(of: str) -> str:
    return f"select case grouping_id(source, origin) when 0 then 'origin' when 1 then 'source' else 'all' end as level, source, origin, count(*) as n from {of} group by rollup (source, origin)"


@query(_corpus(_groups("manifest")))
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_groups(src.manifest(spark, sf_dir))


@query(_corpus(f"""pub as (select id, case when id::bigint % 43 = 0 then null else source end as source, origin from manifest),
planned as (select * from pub where id::bigint % 50 <> 0 and not (source is null and origin = 'simulated')),
g as ({_groups("pub")}), x as ({_groups("planned")} union all select 'source', 'ghost', null, 5)
select coalesce(g.level, x.level) as level, coalesce(g.source, x.source) as source, coalesce(g.origin, x.origin) as origin, g.n, x.n as expected,
 case when x.level is null then 'unexpected' when g.n = x.n then 'met' when g.level is null then 'absent' when g.n < x.n then 'short' else 'over' end as status
from g full join x on g.level = x.level and g.source is not distinct from x.source and g.origin is not distinct from x.origin"""))
def expected_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, some sources unknown, against the totals of a plan that lacks some documents and names a source that is not there."""
    rows = src.manifest(spark, sf_dir).withColumn("source", F.expr("if(cast(id as bigint) % 43 = 0, null, source)"))
    planned = corpus.source_groups(rows.where("cast(id as bigint) % 50 <> 0 and not (source is null and origin = 'simulated')"))
    ghost = spark.createDataFrame([("source", "ghost", None, 5)], "level string, source string, origin string, n long")
    return corpus.against_expected(corpus.source_groups(rows), planned.union(ghost))


_SPLIT = "case when ('0x' || substr(sha256(source), 1, 8))::bigint % 100 < 20 then 'holdout' else 'tuning' end"


@query(_corpus(f"select id, source, {_SPLIT} as split from manifest"))
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.holdout_split(src.manifest(spark, sf_dir)).select("id", "source", "split")


@query(_corpus(f"select id, source, true as same_content, false as same_source from manifest where {_SPLIT} = 'holdout' and sha256 in (select sha256 from manifest where {_SPLIT} = 'tuning')"))
def holdout_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.holdout_leaks(corpus.holdout_split(src.manifest(spark, sf_dir)))


def _reason(name: str, pattern: str) -> str:
    return f"case when regexp_matches(text, '{pattern}') then '{name}' end"


_REASONS = ", ".join(["case when source is null then 'no_source' end", f"case when not regexp_matches(text, '{corpus.LICENCE}') then 'no_licence' end", "case when length(text) < 100 or length(text) > 20000 then 'size' end", *(_reason(n, p) for n, p in corpus.PRIVATE.items())])


@query(f"select doc_id, reasons = '' as admitted, reasons from (select doc_id, concat_ws(',', {_REASONS}) as reasons from documents)")
def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.admission_gate(src.table(spark, sf_dir, "documents"))


@query(_facts(f"""{_PARSED}, i as (select document, name, case when quarter is null then 'annual' else 'quarter' end as grain, period, amount, coalesce(4 * year + quarter, year) as ix from f),
g as (select *, lag(amount) over w as prior0, ix - lag(ix) over w <> 1 as gap from i window w as (partition by document, name, grain order by ix)),
h as (select *, case when prior0 is null then 'first' when gap then 'gap' when prior0 = 0 then 'zero_base' when prior0 < 0 then 'negative_base' end as flag from g)
select document, name, grain, period, amount, case when flag is null or flag in ('zero_base', 'negative_base') then prior0 end as prior, case when flag is null then round(amount::double / nullif(prior0::double, 0) - 1, 6) end as growth, flag from h"""))
def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.growth(_clean(spark, sf_dir))


@query(_facts(f"""{_PARSED}, i as (select document, name, period, amount, year from f where quarter is null),
g as (select *, lag(amount, 3) over w as prior0, year - lag(year, 3) over w <> 3 as gap from i window w as (partition by document, name order by year)),
h as (select *, case when prior0 is null then 'first' when gap then 'gap' when prior0 = 0 then 'zero_base' when prior0 < 0 then 'negative_base' end as flag from g)
select document, name, 'annual' as grain, period, amount, case when flag is null or flag in ('zero_base', 'negative_base') then prior0 end as prior,
 case when flag is null and amount > 0 then round(pow(amount::double / prior0::double, 1e0 / 3) - 1, 6) end as growth, flag from h"""))
def compound_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly rate that leads from each annual amount to that of three years on."""
    return analysis.growth(_clean(spark, sf_dir).where("grain = 'annual'"), 3)


_RATIO = """rt as (select 'S' || e as document, y::varchar as period, round(net_profit_parent::double / nullif(revenue::double, 0), 6) as net_margin, round(operating_cash_flow::double / nullif(net_profit_parent::double, 0), 6) as cash_conversion,
round(equity_parent::double / nullif(assets_total::double, 0), 6) as equity_ratio, cast(net_profit_parent - net_profit_parent_adjusted as decimal(24,4)) as non_recurring,
round(net_profit_parent::double / ((equity_parent::double + (case when lag(y) over w = y - 1 then lag(equity_parent) over w end)::double) / 2), 6) as mean_equity_return
from yf window w as (partition by e order by y))"""


@query(_facts(f"{_RATIO} select * from rt"))
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.ratios(_clean(spark, sf_dir))


ASSUMPTIONS = [("low", 0.02), ("high", 0.05)]
_BASE = _ROLLUP + """, b as (select document, arg_max(annual, year)::double as v from rollup_ where name = 'revenue' and status = 'ok' group by 1), s as (select * from (values ('low', 0.02e0), ('high', 0.05e0)) t(scenario, g)),
pj as (select document, scenario, g, t::int as t, v * pow(1 + g, t) as projected from b, s, range(1, 6) r(t))"""


def _base(rows: DataFrame) -> DataFrame:
    """(document, value): revenue of each entity's latest year whose four quarters add up to it."""
    full = facts.quarter_rollup(rows).where("name = 'revenue' and status = 'ok'")
    return full.groupBy("document").agg(F.max_by("annual", "year").alias("value"))


@query(_facts(f"{_BASE} select document, scenario, g, t, round(projected, 2) as projected from pj"))
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.project(_base(_clean(spark, sf_dir)), ASSUMPTIONS, 5).select("document", "scenario", "g", "t", F.round("projected", 2).alias("projected"))


_PV = "pv as (select document, scenario, round(sum(projected / pow(1.08e0, t)) + arg_max(projected, t) * 1.01e0 / (0.08e0 - 0.01e0) / pow(1.08e0, 5), 2) as present_value, null::varchar as flag from pj group by 1, 2)"


@query(_facts(f"{_BASE}, {_PV} select 'usual' as \"case\", * from pv union all select 'no_end', document, scenario, null, 'r_le_g' from pv"))
def present_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a usual rate, and at one that does not exceed the growth after the last year, which has no finite value."""
    flows = src.stored(analysis.project(_base(_clean(spark, sf_dir)), ASSUMPTIONS, 5), "flows")
    cases = [analysis.present_value(flows, r, g).select(F.lit(name).alias("case"), "*") for name, r, g in (("usual", 0.08, 0.01), ("no_end", 0.03, 0.03))]
    return cases[0].unionByName(cases[1])


GRID = [(g, r, e) for g in (0.02, 0.05) for r in (0.08, 0.10, 0.12) for e in (0.01, 0.02, 0.09)]


@query(_facts(f"""{_BASE}, k as (select * from (values {", ".join(f"({g}e0, {r}e0, {e}e0)" for g, r, e in GRID)}) t(g, r, e)),
c as (select document, r, e, case when r > e then v * (list_sum(list_transform(range(1, 6), lambda t: pow((1 + g) / (1 + r), t))) + pow((1 + g) / (1 + r), 5) * (1 + e) / (r - e)) end as pv from b, k)
select document, round(min(pv), 2) as least, round(quantile_cont(pv, 0.5), 2) as median, round(max(pv), 2) as most, count(pv) as cells, count(*) filter (where r <= e) as r_le_g from c group by 1"""))
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.sensitivity_grid(_base(_clean(spark, sf_dir)), GRID, 5)


@query(_facts("mv as (select 'S' || e as document, y::varchar as period, multiple_name, cast(eps_basic * multiple as decimal(24,4)) as price from yf, (values ('low', 8), ('high', 15)) t(multiple_name, multiple)) select * from mv"))
def multiple_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.multiple_value(_clean(spark, sf_dir), [("low", 8), ("high", 15)])


def _json(**fields: str) -> str:
    """A SQL expression of a JSON object whose null fields are left out; numbers are written as such, text in quotes."""
    parts = ", ".join(f"""case when {x} is not null then '"{name}":' || {f"{x}" if name == "year" else f"""'"' || {x} || '"'"""} end""" for name, x in fields.items())
    return "'{' || concat_ws(',', " + parts + ") || '}'"


def _list(part: str, source: str, order: str, /, **fields: str) -> str:
    return f"j_{part} as (select document, '[' || string_agg({_json(**fields)}, ',' order by {order}) || ']' as \"{part}\" from {source} group by 1)"


_DECIMAL = {n: f"cast({n} as decimal(24,6))::varchar" for n in analysis.RATIOS}


@query(_facts(f"""{_BASE}, {_PV}, {_RATIO},
{_list("facts", "f", "name, period", name="name", period="period", amount="amount::varchar", unit="unit")},
{_list("checks", "rollup_", "name, year", name="name", year="year::varchar", diff="diff::varchar", status="status")},
{_list("ratios", "rt", "period", period="period", **_DECIMAL)},
{_list("values", "pv", "scenario", scenario="scenario", present_value="cast(present_value as decimal(24,2))::varchar", flag="flag")}
select f.document, '{{' || concat_ws(',', '"facts":' || facts, '"checks":' || checks, '"ratios":' || ratios, '"values":' || "values") || '}}' as report
from j_facts f left join j_checks using (document) left join j_ratios using (document) left join j_values using (document)"""))
def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.stored(_clean(spark, sf_dir).select("document", "name", "period", "amount", "unit", "year", "quarter", "grain"), "facts")
    values = analysis.present_value(analysis.project(_base(rows), ASSUMPTIONS, 5), 0.08, 0.01)
    return analysis.entity_report(rows, facts.quarter_rollup(rows), analysis.ratios(rows), values)
