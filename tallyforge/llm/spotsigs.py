"""SpotSigs document fingerprints, in DataFrame functions only.

A spot is a common word; its signature is the chain of the next CHAIN content words
after it. The set of a document's signatures is its fingerprint. Fingerprints are
compared by Jaccard likeness, which set lengths bound: near-duplicate search deals
them to partitions by length, wide enough that two that reach the threshold lie in
the same or in neighbouring ones, and prunes pairs by length before it intersects.

Each document also meets the next one. The order of all is found on keys alone, ranges of
about as many keys each; then every text moves once, to its range, and each range gets a
copy of the one text before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components, pairs_across
from .store import discard, shuffle_partitions, written

CHAIN = 2
#: Ranges of ids for each shuffle partition; equal rows beyond so many count once and are told again at the end.
RANGES, REPEATED = 4, 1000
#: Place of rows without doc_id in the order of ids.
_LOWEST = -(1 << 63)

# The common words of four languages that serve as anchors.
ANCHORS = (
    "a all also an and are as at be been but by can do for from had has have he her his i if in into is it its more no not of on one or our out she so than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und vom von vor war wie wird zu zum zur "
    "al como con del el ella en entre era es esta este ha hay la las lo los más me mi muy no nos para pero por que se sin sobre su sus también un una y ya"
).split()


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _digest(chain: Column) -> Column:
    return F.substring(F.md5(chain.cast("binary")), 1, 16)


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a column of the sorted distinct signatures of a text column, each the first 16 hexadecimal digits of its chain's MD5.

    A text without spots has one signature, of all its words.
    """
    words, content = f"__{out}_words", f"__{out}_content"
    df = df.withColumn(words, _words(F.col(text)))
    stop = lambda w: w.isin(ANCHORS)
    marked = F.transform(words, lambda w, i: F.when(stop(w), F.lit(None)).when((i > 0) & stop(F.get(F.col(words), i - 1)), F.concat(F.lit("^"), w)).otherwise(w))
    df = df.withColumn(content, F.filter(marked, lambda w: w.isNotNull()))
    chain = lambda i: F.concat_ws(" ", *(F.ltrim(F.get(F.col(content), i + k), F.lit("^")) for k in range(CHAIN)))
    spots = F.filter(F.transform(content, lambda w, i: F.when(F.startswith(w, F.lit("^")) & (i + CHAIN <= F.size(content)), _digest(chain(i)))), lambda h: h.isNotNull())
    found = F.sort_array(F.array_distinct(spots))
    whole = F.array(_digest(F.concat(F.lit("="), F.array_join(words, " "))))
    return df.withColumn(out, found).withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(words, content)


def fingerprint(sigs: Column) -> Column:
    """The signatures as one string."""
    return F.array_join(sigs, ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _edited(df: DataFrame) -> DataFrame:
    half = F.expr("n_chars div 2")
    return df.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - n_chars div 2)"), F.substring("next", F.lit(1), half)))


def _longs(values: list[int]) -> Column:
    """A list of numbers as one literal array, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(tops: list[tuple[int, int]]) -> Column:
    """The number of ranges whose last key (id, h) lies below a row's, by bisection."""
    ids, hashes = _longs([i for i, _ in tops]), _longs([h for _, h in tops])
    steps = F.array(*[F.lit(1 << k) for k in range(len(tops).bit_length() - 1, -1, -1)])

    def step(at: Column, k: Column) -> Column:
        last = F.get(ids, at + k - 1)
        below = (last < F.col("id")) | ((last == F.col("id")) & (F.get(hashes, at + k - 1) < F.col("h")))
        return F.when(F.coalesce(below, F.lit(False)), at + k).otherwise(at)

    return F.least(F.aggregate(steps, F.lit(0), step), F.lit(len(tops) - 1))


def fingerprints_with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> fingerprints of each text, its edited text and their likenesses; a row a document.

    The next document is that of the next smaller doc_id; the smallest is followed by the
    largest, and rows of one doc_id by each other in the order of their texts' hashes.
    Rows without doc_id have the smallest of all. The edited text has the last
    floor(n_chars / 2) code points replaced by as many from the start of the next
    document, or all it has.

    Null texts count as empty. Repeated rows are each returned: where one row stands more
    than REPEATED times, all but one of its copies have it as their next. Other columns
    are ignored; an empty table gives none. A fingerprint holds every signature, so it
    grows with its text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("h", F.xxhash64("text"))
    keys = written(docs.select("id", "h"), "keys")
    repeated = written(keys.groupBy("id", "h").agg(F.count("*").alias("n")).where(F.col("n") > F.greatest(F.lit(REPEATED), F.lit(keys.count() // 1_000_000))), "repeated")
    rows = docs.withColumn("n", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        hot = docs.join(F.broadcast(repeated.select("id", "h")), ["id", "h"], "left_semi")
        hot = hot.groupBy("id", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("n"))
        rows = rows.join(F.broadcast(repeated.select("id", "h")), ["id", "h"], "left_anti").select("doc_id", "text", "id", "h", "n").union(hot.select("doc_id", "text", "id", "h", "n"))
        keys = keys.join(F.broadcast(repeated.select("id", "h")), ["id", "h"], "left_anti").union(repeated.select("id", "h"))
    dealt = keys.repartitionByRange(RANGES * shuffle_partitions(spark), "id", "h").groupBy(F.spark_partition_id().alias("at")).agg(F.max(F.struct("id", "h")).alias("top"))
    tops = sorted((r["id"], r["h"]) for r in dealt.select("top.*").collect()) or [(0, 0)]
    rows = rows.select(_range_of(tops).alias("range"), "id", "h", F.lit(True).alias("own"), "doc_id", "text", "n")
    # the text before each range is the last one of the range before, and before the first that of the last
    ends = spark.range(1).select(F.inline(F.arrays_zip(_longs([i for i, _ in tops]).alias("id"), _longs([h for _, h in tops]).alias("h"), F.sequence(F.lit(1), F.lit(len(tops))).alias("to"))))
    before = docs.join(F.broadcast(ends), ["id", "h"]).groupBy("to").agg(F.first("id").alias("id"), F.first("h").alias("h"), F.first("text").alias("text"))
    before = before.select((F.col("to") % len(tops)).alias("range"), "id", "h", F.lit(False).alias("own"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(1).cast("long").alias("n"))
    order = Window.partitionBy("range").orderBy("own", "id", "h")
    seen = rows.union(before).withColumn("next", F.lag("text").over(order))
    seen = signatures(seen, "text", "sigs").withColumn("next_sigs", F.lag("sigs").over(order)).where("own")
    # of copies told once, one has the row before as its next and the others have the row itself
    seen = seen.withColumn("copy", F.explode(F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    seen = seen.withColumns({"next": F.when(F.col("copy") == 1, F.col("text")).otherwise(F.col("next")), "next_sigs": F.when(F.col("copy") == 1, F.col("sigs")).otherwise(F.col("next_sigs"))})
    seen = signatures(_edited(seen.withColumn("n_chars", F.char_length("text").cast("long"))), "edited", "edited_sigs")
    found = seen.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), "copy", "n",
    )
    times = F.when(F.col("copy") == 1, F.sequence(F.lit(2).cast("long"), F.col("n"))).otherwise(F.array(F.lit(0).cast("long")))
    return found.withColumn("turn", F.explode(times)).drop("copy", "n", "turn")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_signatures, component_id), a row a document: documents joined by fingerprints of at least that likeness.

    Equal fingerprints collapse first. Each remaining one shows its rarest signatures,
    enough that two alike share one, in its partition of lengths and the next; pairs
    that meet there are pruned by length and then intersected. Pairs within a group
    are met through its shortest member and, beyond that, only between different
    components; component_id is the smallest doc_id reached.

    Null texts count as empty, and texts without words are alike. Repeated rows are each
    returned. A row without doc_id is returned with a null component_id and joins
    nothing. Other columns are ignored; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # sets are named by 128 bits, so that no two of 10^10 are expected to clash
    ids = written(signatures(docs, "text", "sigs").select("doc_id", "sigs", F.size("sigs").cast("long").alias("n_signatures"), F.unhex(F.md5(F.concat_ws(",", "sigs"))).alias("cls")), "fingerprints")
    sets = written(ids.where("doc_id is not null").groupBy("cls").agg(F.first("sigs").alias("sigs"), F.min("doc_id").alias("rep")).withColumn("n", F.size("sigs")), "sets")
    shown = sets.select("cls", "n", F.explode("sigs").alias("sig"))
    # signatures of one set alone come first in its order and link nothing, so they are counted and go no further than their own count
    df = shown.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    prefix = F.expr(f"n - cast(ceil({threshold} * n - 1e-9) as int) + 1")
    of_set = Window.partitionBy("cls")
    at = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("df", "sig"))
    ranked = shown.join(df, "sig").withColumn("at", at).where(F.col("at") <= prefix)
    lane = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    lanes = written(ranked.withColumn("lane", F.explode(F.array(lane, lane + 1))).select("sig", "lane", "cls", "n"), "lanes")
    keys = lanes.groupBy("sig", "lane").agg(F.min_by("cls", F.struct("n", "cls")).alias("a"))
    sides = sets.select("cls", "sigs", "n")

    def alike(pairs: DataFrame) -> DataFrame:
        a, b = (sides.select(F.col("cls").alias(x), F.col("sigs").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        met = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
        return met.where(likeness(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")

    star = lanes.join(keys, ["sig", "lane"]).where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    edges = written(alike(star), "alike")
    parts = components(edges).withColumnRenamed("node", "cls")
    posts = lanes.join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    rest = pairs_across(posts, ["sig", "lane"], f"least(a_n, b_n) >= {threshold} * greatest(a_n, b_n) - 1e-9")
    parts = components(edges.union(written(alike(rest), "alike"))).withColumnRenamed("node", "cls")
    named = sets.select("cls", "rep").join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = ids.select("doc_id", "n_signatures", "cls").join(named.join(least, "component").select("cls", "component_id"), "cls", "left")
    return found.select("doc_id", "n_signatures", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
