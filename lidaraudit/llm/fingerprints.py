"""Document fingerprints: a homomorphic multiset hash of paragraphs; DataFrame functions only.

A text is the multiset of the pieces of its paragraphs: each line is cut after each sentence, and
after PIECE_WORDS words where none ends. Each piece is hashed to a wide vector by four hashes of
different seeds: 128 lanes of one bit and 4 lanes of 32 bits. The fingerprint is the number of pieces
and the sum of the vectors, every lane modulo 2**30 (the counts of bits) or 2**32 (the wide ones). So the order
of pieces doesn't matter, equal multisets have equal fingerprints, and a piece that is
inserted or deleted is added or subtracted (`merged`, `without`) without the rest of the text.
Read as -1 and 1, the bits of different pieces are nearly orthogonal, so the cosine of two sums is about the
share of pieces that two texts have in common: `likeness`.

State: array<long>; the number of pieces, 64 words of two counts (32 bits apart, so that no carry reaches
the next one, for fewer than 2**30 pieces), then 4 wide lanes.

Defined cases: a null text is an empty one; an empty text has the fingerprint of the empty
multiset, which is like itself (1.0) and unlike any other (0.0); the next document goes by
descending doc_id, then by a hash of the text where rows share a doc_id, null ids last; a
single document is its own next one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lidaraudit.llm.common import read_documents

PIECE_WORDS = 16
#: Words of one line up to the end of a sentence, without going back into what has matched.
PIECE = rf"\S++(?:(?<![.!?])[^\S\n]++\S++){{0,{PIECE_WORDS - 1}}}+"
#: Words of counts, of two counts each, and wide lanes.
WORDS, WIDE = 64, 4
ONES, LOW = 0x0000000100000001, 0x3FFFFFFF3FFFFFFF
LIMIT = 0x4000000040000000
#: Documents of a range of doc_id, within which they are put in order.
RANGE_ROWS = 1024
#: Ranges: quantiles of doc_id, cut evenly further; the first ids of all ranges are broadcast, 24 bytes each, so this bounds the broadcast.
MOST_BOUNDS, MOST_RANGES = 2047, 1 << 20


def once(value: Column, use) -> Column:
    """use(value), where value is worked out once though the lambdas in use name it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _counts(hashes: Column) -> Column:
    """For each of 32 places: how many hashes have the bit there, and how many 32 places above."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + F.call_function("shiftright", h, i).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(LOW))),
    )


def _halves(hashes: Column) -> Column:
    """Sums of the low and of the high 32 bits, modulo 2**32."""

    def total(shift: int) -> Column:
        half = lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + half(h)).bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.array(total(0), total(32))


def state_of(text: Column) -> Column:
    """The fingerprint of a text as numbers."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    # The number of the hash comes first and so is its seed: pieces that are alike in one differ in another.
    seeded = lambda p, k: F.transform(p, lambda x: F.xxhash64(F.lit(k), x))

    def all_lanes(p: Column) -> Column:
        counts = [once(seeded(p, k), _counts) for k in (0, 1)]
        return F.concat(F.array(F.size(p).cast("long")), *counts, *[once(seeded(p, k), _halves) for k in (2, 3)])

    return once(pieces, all_lanes)


def _lanewise(a: Column, b: Column, counts, wide) -> Column:
    """Both states' counts and wide lanes, word by word."""
    return F.concat(
        F.zip_with(F.slice(a, 2, WORDS), F.slice(b, 2, WORDS), lambda x, y: counts(x, y).bitwiseAND(F.lit(LOW))),
        F.zip_with(F.slice(a, 2 + WORDS, WIDE), F.slice(b, 2 + WORDS, WIDE), lambda x, y: wide(x, y).bitwiseAND(F.lit(0xFFFFFFFF))),
    )


def merged(a: Column, b: Column) -> Column:
    """The state of two texts' pieces together."""
    return F.concat(F.array(F.element_at(a, 1) + F.element_at(b, 1)), _lanewise(a, b, lambda x, y: x + y, lambda x, y: x + y))


def without(a: Column, b: Column) -> Column:
    """The state after the pieces of b are deleted from those of a: the modulus is added to each lane first."""
    return F.concat(
        F.array(F.element_at(a, 1) - F.element_at(b, 1)),
        _lanewise(a, b, lambda x, y: x + F.lit(LIMIT) - y, lambda x, y: x + F.lit(1 << 32) - y))


def fingerprint(state: Column) -> Column:
    """The state in hexadecimal digits."""
    return F.array_join(F.transform(state, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _sums(state: Column) -> Column:
    """Each bit's lane as the sum of -1 and 1: twice its count less the number of pieces."""
    n = F.element_at(state, 1)
    lanes = F.flatten(F.transform(F.slice(state, 2, WORDS), lambda w: F.array(w.bitwiseAND(F.lit(0x3FFFFFFF)), F.shiftrightunsigned(w, 32))))
    return once(n, lambda m: F.transform(lanes, lambda c: (2 * c - m).cast("double")))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the two sums, 0 where it is negative; 1 for equal states."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def cosine(both: Column) -> Column:
        x, y = both["x"], both["y"]
        return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y))), F.lit(0.0))

    value = once(F.struct(_sums(a).alias("x"), _sums(b).alias("y")), cosine)
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def _range_of(doc_id: Column, bounds: list[int], fine: int) -> tuple[Column, Column]:
    """Number of the quantile, for a column `coarse`, and of the range of doc_id, both ascending; null ids are in the first. bounds: the least id, quantiles, the largest id.

    The quantile is found by binary search; between two of them ids are cut evenly into `fine` ranges.
    """
    table = F.array(*[F.lit(b) for b in bounds])
    at = lambda i: F.element_at(table, i + 1)
    middle = lambda s: F.shiftright(s["lo"] + s["hi"] + 1, 1)
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(at(middle(s)) <= doc_id, F.struct(middle(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (middle(s) - 1).alias("hi")))
    last = max(0, len(bounds) - 2)
    start = F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi"))
    coarse = F.aggregate(F.sequence(F.lit(1), F.lit(last.bit_length() + 1)), start, step)["lo"]
    # Doubles keep order and don't overflow; ids that they can't tell apart fall into one range.
    low, high = at(F.col("coarse")).cast("double"), at(F.col("coarse") + 1).cast("double")
    share = F.coalesce(F.try_divide(doc_id.cast("double") - low, high - low), F.lit(0.0))
    part = F.col("coarse") * F.lit(fine) + F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0 - 1e-9)) * fine)
    return coarse, F.when(doc_id.isNull(), F.lit(0)).otherwise(part).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, state and the next document's next_text and next_state.

    Documents are put in order within ranges of doc_id, in one shuffle of the texts. A range's first
    document is the next one of the last document of the range above: it goes to that range as well, as
    one more row. Which documents are first is told by a broadcast table of ids, at most MOST_RANGES rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, least, largest = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = min(MOST_RANGES, max(1, rows // RANGE_ROWS))
    quantiles = min(MOST_BOUNDS, ranges)
    inner = docs.agg(F.percentile_approx("doc_id", [i / quantiles for i in range(1, quantiles)])).first()[0] if quantiles > 1 and least is not None else []
    bounds = [least or 0, *sorted({b for b in inner or [] if least < b < largest}), largest or 0]
    coarse, part = _range_of(F.col("doc_id"), bounds, -(-ranges // quantiles))
    docs = docs.withColumn("coarse", coarse).withColumn("part", part).withColumn("tie", F.xxhash64("text")).drop("coarse")

    first = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie")))
    down = Window.orderBy(F.desc("part"))  # a row for each range, 24 bytes
    firsts = docs.groupBy("part").agg(first.alias("first"))
    heads = firsts.select(F.col("first.doc_id").alias("head_id"), F.bitwise_not("first.tie").alias("head_tie"), F.coalesce(F.lag("part").over(down), F.min("part").over(Window.partitionBy())).alias("above"))
    known = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")), "left")
    places = F.when(F.col("above").isNull(), F.array(F.struct("part", F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("above").alias("part"), F.lit(1).alias("guest"))))
    placed = known.withColumn("place", F.explode(places)).select("doc_id", "text", "tie", "place.part", "place.guest")

    order = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    # Column by column: a struct of both would go through the shuffle beside them.
    seen = placed.withColumn("state", state_of(F.col("text"))).select(
        "*", F.lead("text").over(order).alias("next_text"), F.lead("state").over(order).alias("next_state"))
    return seen.where("guest = 0").select("doc_id", "text", "state", "next_text", "next_state")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many of following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(read_documents(spark, sf_dir))
    changed = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    states = changed.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "state", "next_state", state_of(F.col("edited")).alias("edited_state"))
    return states.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("state")).alias("fingerprint"), fingerprint(F.col("edited_state")).alias("edited_fingerprint"),
        likeness(F.col("state"), F.col("edited_state")).alias("near_edited"),
        likeness(F.col("state"), F.col("next_state")).alias("near_next"))


QUERIES = {"op10_multiset_hash": op10_multiset_hash}
ORACLE: dict[str, str] = {}
