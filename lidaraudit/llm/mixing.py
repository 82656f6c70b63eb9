"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Each source gets a target of words. A source whose target is r times its size first gives
floor(r) whole copies of every document, for certain. The rest of the target, W words, is
a sample with unequal probabilities: a document of s words is included with p = c * s, at most 1, where c makes the
expected number of words W (those that would pass 1 are certain, and c is that of the others). In Pareto
order sampling (Rosen 1997) each document draws u and has the rank (u / (1 - u)) / (p / (1 - p)), its random
odds over its inclusion odds, and the documents of lowest rank are the sample. Its size is fixed in
words: the document at which W is reached is taken in part, all others whole.

c comes from a table of how many documents of a source have how many words, so no source is
ordered in one task: ranks are put into bins, words are summed by source and bin, and only the bin in
which a source reaches W is ordered; bins grow in number with the documents. Tables with a row per
source are written, counted, and broadcast if they have at most BROADCAST_SOURCES rows; so documents
stay where they are, but for those few.

Defined cases: null, empty and blank texts have size 0 and are never taken; a null source
is a source of its own, last in order; ties of rank go by doc_id, and repeated rows count as
separate documents; an empty table gives an empty result; further columns of any name are kept unless
they bear the name of a result column, which is then replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidaraudit.llm.common import read_documents, written

#: Bins of ranks in a source: at least so many, and one for each so many documents of all.
BINS, DOCS_PER_BIN = 4096, 512
#: Rows of a table of sources that may be broadcast; a longer one is joined by shuffles.
BROADCAST_SOURCES = 100_000
RESULTS = ("size", "source_size", "target", "taken")


def words_in(text: Column) -> Column:
    """Words of a text: other white space becomes blanks, and the parts between blanks that aren't empty are counted."""
    blank = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("long")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the parts alone: 48 bits of their MD5."""
    digest = F.substring(F.md5(F.concat_ws("/", *parts)), 1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target.

    sizes: source, size, and n, how many documents of the source have that size (1 if it is missing). Sources in
    code-point order, null last, take the weights in turn. The level of the weights is found from prefix
    sums: sources are ordered by where their weight would lift them to the limit, and the first k are
    limited for the k for which the level that is left for the others limits none of them.
    """
    words = F.col("size") * F.col("n") if "n" in sizes.columns else F.col("size")
    one = Window.orderBy(F.col("source").asc_nulls_last())
    by_source = sizes.groupBy("source").agg(F.sum(words).alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    weighed = by_source.withColumn("w", pick).withColumn("at", most * F.col("source_size") / F.col("w"))
    order = Window.orderBy("at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    rest_words = share * total - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    rest_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = weighed.withColumn("level", rest_words / rest_weight)
    # The first source that its level does not lift over the limit sets the level of all after it.
    level = level.withColumn("cut", F.min(F.when(F.col("at") > F.col("level"), F.struct("at", "level"))).over(everything))
    target = F.when(F.col("cut").isNull() | (F.col("at") < F.col("cut.at")), most * F.col("source_size")).otherwise(F.least(F.col("cut.level") * F.col("w"), most * F.col("source_size")))
    return level.select("source", "source_size", target.alias("target"))


def _small(table: DataFrame, name: str) -> DataFrame:
    """The table written, with a hint to broadcast it if it is short enough."""
    table = written(table, name)
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def _shares(hist: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with copies, more (words of the sample), and certain_over and c: larger documents are certain, others have p = c * size.

    Sizes of a source from the largest down: c for the case that all larger ones are certain; the first
    size that this c doesn't lift over 1 tells.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    whole = targets.withColumn("copies", copies).withColumn("more", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    full = (F.col("more") > 0) & (F.col("more") >= F.col("source_size"))  # a rest that is the whole source is one more copy
    whole = whole.select("source", "source_size", "target", (F.col("copies") + F.when(full, 1).otherwise(0)).alias("copies"), F.when(full, 0).otherwise(F.col("more")).cast("long").alias("more"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    words = F.col("n") * F.col("size")
    squares = (words.cast("decimal(38,0)") * F.col("size").cast("decimal(19,0)")).cast("decimal(38,0)")
    larger = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(squares).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    each = hist.where("size > 0").withColumnRenamed("source", "of").join(whole, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    each = each.withColumns({"larger": larger, "rest": rest}).withColumn("c", (F.col("more") - F.col("larger")) / F.col("rest"))
    found = each.where(F.col("c") * F.col("size") <= 1).groupBy("source").agg(F.max_by(F.struct("size", "c"), "size").alias("s"))
    found = found.select(F.col("source").alias("of"), F.col("s.size").alias("certain_over"), F.col("s.c").alias("c"))
    return whole.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns of docs (or those of keep) with size, source_size, target and taken (words that the mix takes, repeats counted)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    # What documents bring along stays in one column, so that its names can't clash with those below.
    sized = docs.select(F.struct(*kept).alias("row"), "doc_id", F.col("source").alias("own_source"), words_in(F.col("text")).alias("size"))
    hist = written(sized.groupBy(F.col("own_source").alias("source"), "size").agg(F.count("size").alias("n")), "sizes")
    targets = _small(_shares(hist, source_targets(hist, weights, share, most)), "targets")
    rows = hist.agg(F.sum("n")).first()[0] or 0
    bins = max(BINS, 1 << max(0, rows // DOCS_PER_BIN).bit_length())

    u = uniform(F.lit(seed), F.col("doc_id").cast("string"))
    p = F.when((F.col("more") <= 0) | (F.col("size") <= 0), 0.0).when(F.col("size") > F.col("certain_over"), 1.0).otherwise(F.least(F.col("c") * F.col("size"), F.lit(1.0)))
    # Ranks go from 0 (certain) to infinity; rank / (1 + rank) keeps the order and is at most 1.
    odds, inclusion = F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p"))
    rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, odds / inclusion)
    ranked = (
        sized.join(targets, F.col("own_source").eqNullSafe(F.col("source"))).drop("own_source")
        .withColumns({"p": p, "u": u}).withColumn("rank", rank)
        .withColumn("bin", F.when(F.col("rank").isNull(), F.lit(bins)).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * bins)).cast("int"))
    )
    per_bin = ranked.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("more").alias("more"))
    upto = Window.partitionBy("source").orderBy("bin")
    cuts = (
        per_bin.withColumn("upto", F.sum("words").over(upto))
        .where("upto >= more").groupBy("source")
        .agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("cut"))
        .select(F.col("source").alias("cut_source"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))
    )
    cuts = _small(cuts, "cuts")
    placed = ranked.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    whole = placed.where("cut_bin is null or bin <> cut_bin").withColumn("part", F.when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(0))
    inside = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("more") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = placed.where("bin = cut_bin").withColumn("part", F.least(F.col("size"), F.greatest(left, F.lit(0))))
    out = whole.unionByName(edge).withColumn("taken", (F.col("copies") * F.col("size") + F.col("part")).cast("long"))
    return out.select("row.*", "size", "source_size", "target", "taken")


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: as many rows of each as copies are taken.

    A document that is taken in part counts as taken when at least half of it is.
    """
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("mixed_row"))
    mixed = mix(whole, keep=["mixed_row"], **options).where(copies > 0)
    return mixed.select("mixed_row", F.explode(F.sequence(F.lit(1), copies))).select("mixed_row.*")


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w
  FROM by_source),
levels AS (
  SELECT a.source, a.source_size, a.w, 2e0 * a.source_size / a.w AS lim,
    (1.5e0 * (SELECT sum(source_size) FROM by_source) - coalesce(sum(2e0 * b.source_size), 0))
      / ((SELECT sum(w) FROM weighed) - coalesce(sum(b.w), 0)) AS level
  FROM weighed a LEFT JOIN weighed b
    ON 2e0 * b.source_size / b.w < 2e0 * a.source_size / a.w
    OR (2e0 * b.source_size / b.w = 2e0 * a.source_size / a.w AND (b.source < a.source OR (a.source IS NULL AND b.source IS NOT NULL)))
  GROUP BY a.source, a.source_size, a.w),
cut AS (SELECT min(lim) AS lim, arg_min(level, lim) AS level FROM levels WHERE lim > level),
targets AS (
  SELECT source, source_size,
    CASE WHEN cut.lim IS NULL OR levels.lim < cut.lim THEN 2e0 * source_size ELSE least(cut.level * w, 2e0 * source_size) END AS target
  FROM levels, cut),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM targets),
rests AS (SELECT *, CAST(round(target - copies * source_size) AS BIGINT) AS more FROM shares),
by_size AS (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size),
cs AS (
  SELECT b.source, b.size,
    (r.more - coalesce(CAST(sum(b.n * b.size) OVER (PARTITION BY b.source ORDER BY b.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
      / CAST(sum(b.n * b.size * b.size) OVER (PARTITION BY b.source ORDER BY b.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c
  FROM by_size b JOIN rests r ON b.source IS NOT DISTINCT FROM r.source),
certain AS (SELECT source, max(size) AS certain_over, arg_max(c, size) AS c FROM cs WHERE c * size <= 1 GROUP BY source),
drawn AS (
  SELECT s.doc_id, s.size, r.*,
    (CAST(CAST('0x' || substr(md5('mix/' || s.doc_id), 1, 12) AS BIGINT) AS DOUBLE) + 0.5e0) / 281474976710656e0 AS u,
    CASE WHEN r.more <= 0 OR s.size <= 0 THEN 0e0 WHEN s.size > k.certain_over THEN 1e0 ELSE least(k.c * s.size, 1e0) END AS p
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN certain k ON s.source IS NOT DISTINCT FROM k.source),
ranked AS (SELECT *, CASE WHEN p >= 1 THEN 0e0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 'infinity'::DOUBLE END AS rank FROM drawn),
sums AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked)
SELECT doc_id, size, source_size, target,
  CAST(copies * size + least(size, greatest(more - before, 0)) AS BIGINT) AS taken
FROM sums
"""
QUERIES = {"op3_pareto_mix": op3_pareto_mix}
ORACLE = {"op3_pareto_mix": ORACLE_OP3}
