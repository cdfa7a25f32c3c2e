"""URL filter: explicit host rules first, then empirical-Bayes host reputation.

Outcomes of labelled pages are shrunk through beta-binomial priors from the host to
its registered domain and from there to its suffix and the whole. The strength of
each level's prior is fitted by moments from how much the groups below it differ.
A host passes when the lower posterior bound of its share of good pages does.
Only DataFrame functions are used. Counts by host are stored once; all levels are made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

#: Hosts up to which their reputations are broadcast (about 200 bytes each), so that the pages of a frequent host stay dealt.
BROADCAST_HOSTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second-level labels under which country registries register names; fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gub", "idv", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
# Names below which others register, cities of one country and hosting services; fixed values.
SHARED = (
    "kawasaki.jp", "kitakyushu.jp", "kobe.jp", "nagoya.jp", "sapporo.jp", "sendai.jp", "yokohama.jp",
    "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "glitch.me", "herokuapp.com", "neocities.org",
    "netlify.app", "onrender.com", "pages.dev", "readthedocs.io", "surge.sh", "tumblr.com", "vercel.app", "web.app", "wordpress.com", "workers.dev",
)
#: A suffix of more than one label, and a host that is an address; both as patterns.
LONG_SUFFIX = "(?:" + "|".join(SECOND_LEVEL) + r")\.[a-z][a-z]|" + "|".join(s.replace(".", r"\.") for s in SHARED)
ADDRESS = r"\[.*\]|\d+\.\d+\.\d+\.\d+"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for a null url or one without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, the last two under a country's second-level name or below a shared name, or the whole of an address."""
    whole = F.regexp_extract(host, rf"^({ADDRESS})(?::\d+)?$", 1)
    last2 = F.regexp_extract(host, rf"(?:^|\.)({LONG_SUFFIX})(?::\d+)?$", 1)
    return F.when(whole != "", whole).when(last2 != "", last2).otherwise(F.regexp_extract(host, r"([^.:]*)(?::\d+)?$", 1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one more label, or the host where there is none."""
    plain = F.regexp_replace(host, r":\d+$", "")
    rest = F.expr("substring(plain, 1, greatest(length(plain) - length(suffix) - 1, 0))")
    return F.when(rest == "", plain).otherwise(F.concat_ws(".", F.regexp_extract(rest, r"[^.]*$", 0), suffix))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """[(action, 'host/path')] -> (rule_host, rule_path, rule, action)."""
    values = [F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule")) for a, r in rules]
    rows = spark.range(1).select(F.inline(F.array(*values)))
    return rows.select(
        F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"), "rule", "action"
    )


def _level(groups: DataFrame, parent: Column, key: str) -> tuple[DataFrame, float]:
    """groups (key, n, k, parent mean) -> with its posterior mean; and the prior's strength, fitted by moments."""
    m = parent
    spread, room = F.pow(F.col("k") - F.col("n") * m, 2) - F.col("n") * m * (1 - m), F.col("n") * (F.col("n") - 1) * m * (1 - m)
    sums = groups.agg(F.sum(spread).alias("s"), F.sum(room).alias("r")).first()
    rho = min(max((sums["s"] or 0.0) / sums["r"], 1e-3), 0.5) if sums["r"] else 1e-3
    strength = round(1 / rho - 1, 6)
    return groups.withColumn(key, (F.col("k") + strength * m) / (F.col("n") + strength)), strength


def host_reputation(hosts: DataFrame, *, z: float = 1.645) -> DataFrame:
    """hosts (host, n labelled pages, k good ones) -> (host, n, k, mean, bound): the posterior of the share of good pages.

    Hosts without labelled pages get their domain's posterior. The three fitted
    prior strengths are all that reaches the driver.
    """
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("plain", F.regexp_replace("host", r":\d+$", ""))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))).drop("plain")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = F.lit(((total["k"] or 0) + 1) / ((total["n"] or 0) + 2))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes, _ = _level(hosts.groupBy("suffix").agg(*sums), overall, "suffix_mean")
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes.select("suffix", "suffix_mean"), "suffix")
    domains, _ = _level(domains, F.col("suffix_mean"), "domain_mean")
    hosts = hosts.join(domains.select("domain", "domain_mean"), "domain")
    hosts, strength = _level(hosts, F.col("domain_mean"), "mean")
    mass = F.col("n") + strength + 1
    bound = F.greatest(F.lit(0.0), F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / mass))
    return hosts.select("host", "n", "k", "mean", bound.alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, *, min_good: float = 0.5, z: float = 1.645) -> DataFrame:
    """pages (page_id, url), outcomes (page_id, good boolean), rules as of rules_frame -> a row a page.

    Returns page_id, host, path, rule (the longest that fits, else null), verdict
    (the rule's, else allow when the host's bound reaches min_good, else block),
    n_labelled and bound of the host. A rule fits its host and all subdomains when
    the path starts with the rule's path. A port is part of the host: no rule without
    it fits, but reputation counts the domain and suffix before it.

    Null urls and urls without :// have an empty host, judged as one host. Repeated
    page_ids are each judged; outcomes with a null page_id or good are ignored. An
    empty table gives none. Other columns are ignored.
    """
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    good = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    counts = pages.select("page_id", "host").join(good, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = written(counts, "hosts")
    few = hosts.count() <= BROADCAST_HOSTS
    known = host_reputation(hosts, z=z)
    labels = F.split("host", r"\.")
    suffixes = known.select("host", labels.alias("labels")).select("host", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")).alias("rule_host"))
    of_host = suffixes.join(rules, "rule_host").groupBy("host").agg(F.collect_list(F.struct("rule_path", "rule", "action")).alias("rules"))
    known = known.join(of_host, "host", "left")
    fits = F.array_max(F.transform(F.filter(F.coalesce("rules", F.expr("cast(array() as array<struct<rule_path: string, rule: string, action: string>>)")), lambda r: F.startswith(F.col("path"), r["rule_path"])), lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["action"].alias("action"))))
    judged = pages.join(F.broadcast(known) if few else known, "host").withColumn("fit", fits)
    verdict = F.coalesce(F.col("fit.action"), F.when(F.col("bound") >= min_good, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("n_labelled"), F.round("bound", 6).alias("bound"))
