"""Language ID: interpolated Kneser-Ney character models of each language in sorted hash arrays.

Characters. Letters (str.isalpha, and marks that combine with them) count in small form; every run of
others is one separator. A text is a separator, its characters, and a separator; what stands before
it are separators. Windows are ORDER characters that end in each character but the first separator.

Counting. A task counts distinct windows of each language run by run; Spark adds them up by language and
window. Shorter windows are counted by how many different characters stand before them
(continuation counts), each order from the distinct windows of the next one, and contexts by sum and kinds of
their windows. Every text of the learning part counts, but for the CALIBRATION share.

Model. P_k(c|h) = max(n(hc) - D_k, 0) / n(h) + D_k * kinds(h) / n(h) * P_{k-1}(c|h'), P_0 uniform over all
characters seen; D_k = n1 / (n1 + 2 n2) of each language and order. Rows of (language, window) are dealt by the high
bits of the window's hash; a task writes one shard: sorted hashes, and the languages and counts of each.
Workers map the shards they meet, whose number grows with the rows.

Choice. The language of least mean bits a character is predicted, ties by name. Calibration: on the share of learning
texts that no model counts, in bins of evidence (bits by which the second is worse), a logistic curve is
fitted to how often the choice is right; it gives the score. A choice is `rejected` if its bits a
character exceed nearly all (KEPT) of right choices of its language there, by more than SLACK, or if its score is
below LEAST_SCORE; the prediction stays, as there is no other.

A hash of 64 bits stands for a window, so of n distinct ones a share of about n / 2**64 is taken for another.

Defined cases: texts that are null or without letters are `und` with score 0, and rejected; null languages are not
learnt from; a null doc_id is in the learning part; without learning texts all are `und`; repeated
rows count each; a text longer than a run is read in pieces that carry the last characters on;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import bound_batches, grouped, mapped, mix64, read_documents, text_buffer, work_folder, written
from lidaraudit.llm.lm_scoring import Files

ORDER = 5
SEPARATOR = 32
#: One in so many learning texts calibrates; their share is CALIBRATION of all.
CALIBRATION = 10
KEPT, SLACK, LEAST_SCORE = 0.999, 0.5, 0.5
#: Bytes of text of a run.
RUN_BYTES = 1 << 20
#: Rows of a shard that the number of shards aims at, and the least number as a power of two.
SHARD_ROWS, LEAST_BITS = 2 << 20, 6
#: Cells of windows by languages that are worked out at a time, and that a worker remembers before it begins anew.
CELLS = 4 << 20
#: Multipliers of the places of a window, and what is added for its length.
PLACES = mix64(np.arange(1, ORDER + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
LENGTHS = mix64(np.arange(101, 102 + ORDER, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
CONTEXT = np.uint64(0xBB67AE8584CAA73B)
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its small form if it is a letter or a combining mark, else the separator; and if it is a letter."""
    small, letter = np.full(0x110000, SEPARATOR, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        letter[i] = c.isalpha()
        if letter[i] or unicodedata.category(c)[0] == "M":
            low = c.lower()
            small[i] = ord(low) if len(low) == 1 else i
    return small, letter


@dataclass
class Stream:
    """Characters of whole texts or of a piece of one: code, place in its text, text; what counts begins where `counts`."""

    code: np.ndarray
    place: np.ndarray
    text: np.ndarray
    counts: np.ndarray


def _stream(raw: bytes, ends: np.ndarray, first: int, carried: np.ndarray | None, closed: bool) -> Stream:
    """ends: of each text in raw. carried: the last characters of the piece before, for one text alone; closed: the text ends here."""
    data = np.frombuffer(raw, np.uint8)
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts_char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    stops = starts_char[ends]
    code = code_points()[0][points]
    sizes = np.diff(stops, prepend=0)
    lead = np.array([SEPARATOR], np.uint32) if carried is None else carried
    tail = 1 if closed else 0
    text = np.repeat(np.arange(len(ends)), sizes + len(lead) + tail)
    out = np.full(len(text), SEPARATOR, np.uint32)
    begin = np.cumsum(sizes + len(lead) + tail) - (sizes + len(lead) + tail)
    at = np.arange(len(code)) - np.repeat(stops - sizes, sizes) + np.repeat(begin + len(lead), sizes)
    out[at] = code
    for k, c in enumerate(lead):
        out[begin + k] = c
    place = np.arange(len(out)) - begin[text]
    keep = (out != SEPARATOR) | (place < len(lead))
    keep[1:] |= out[:-1] != SEPARATOR
    out, text = out[keep], text[keep]
    begin = np.searchsorted(text, np.arange(len(ends)))
    place = np.arange(len(out)) - begin[text]
    return Stream(out, place, text + first, place >= len(lead))


def streams(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[Stream]:
    """Runs of whole texts of at most limit bytes; a longer text comes in pieces."""
    data, borders = text_buffer(column)
    a, n = 0, len(borders) - 1
    while a < n:
        b = max(a + 1, min(n, int(np.searchsorted(borders, borders[a] + limit, "right")) - 1))
        if borders[b] - borders[a] <= limit:
            yield _stream(data[borders[a] : borders[b]].tobytes(), borders[a + 1 : b + 1] - borders[a], a, None, True)
        else:
            at, end, carried = int(borders[a]), int(borders[b]), None
            while at < end:
                stop = min(at + limit, end)
                while stop < end and data[stop] & 0xC0 == 0x80:  # not within a character
                    stop -= 1
                piece = _stream(data[at:stop].tobytes(), np.array([stop - at]), a, carried, stop == end)
                yield piece
                carried, at = piece.code[-ORDER:], stop
        a = b


def windows(s: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each counted character: hash of its window, index in the stream, text."""
    wanted = np.flatnonzero(s.counts)
    total = np.zeros(len(s.code), np.uint64)
    spread = mix64(s.code.astype(np.uint64) + np.uint64(1))
    blank = mix64(np.array([SEPARATOR + 1], np.uint64))[0]
    for j in range(ORDER):
        shifted = np.full(len(spread), blank, np.uint64)
        shifted[j:] = spread[: len(spread) - j]
        shifted[s.place < j] = blank
        total += shifted * PLACES[j]
    return total[wanted], wanted, s.text[wanted]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct hash, their counts, and which of them each hash is."""
    order = hashes.argsort()
    new = np.empty(len(hashes), bool)
    new[:1] = True
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    first = np.flatnonzero(new)
    back = np.empty(len(hashes), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[first], np.diff(first, append=len(hashes)), back


def codes_at(s: Stream, at: np.ndarray) -> np.ndarray:
    """The windows that end at these indexes, oldest character first."""
    out = np.full((len(at), ORDER), SEPARATOR, np.int32)
    for j in range(ORDER):
        there = s.place[at] >= j
        out[there, ORDER - 1 - j] = s.code[at[there] - j]
    return out


def key_of(codes: np.ndarray, context: bool) -> np.ndarray:
    """64-bit keys of windows or of contexts (codes: oldest first)."""
    total = np.full(len(codes), LENGTHS[codes.shape[1]] ^ (CONTEXT if context else np.uint64(0)), np.uint64)
    for j in range(codes.shape[1]):
        total += mix64(codes[:, codes.shape[1] - 1 - j].astype(np.uint64) + np.uint64(1)) * PLACES[j]
    return mix64(total)


def calibrates(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(CALIBRATION)) == 0, F.lit(False))


def learning(doc_id: Column) -> Column:
    """The learning part of the contract: crc32 of doc_id as text mod 3 is not 1. A null doc_id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


NAMES = [f"c{k}" for k in range(1, ORDER + 1)]


def _counted(run_bytes: int):
    """A function for mapInArrow: distinct windows of each language in a run, and how often they stand there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            number, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary
            salt = mix64(np.arange(1, len(names) + 1, dtype=np.uint64))
            for s in streams(batch["text"], run_bytes):
                hashes, at, text = windows(s)
                if not len(at):
                    continue
                first, n, _ = distinct(hashes + salt[number[text]])
                codes = codes_at(s, at[first])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(number[text[first]])), *(pa.array(np.ascontiguousarray(codes[:, k])) for k in range(ORDER)), pa.array(n.astype(np.int64))], ["lang", *NAMES, "n"])

    return work


def _keyed(bits: int, langs: dict[str, int]):
    """A function for mapInArrow: rows of windows (types null) and contexts with their key and shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, types = batch["k"].to_numpy(), batch["types"].to_numpy(zero_copy_only=False)
            context = ~np.isnan(types.astype(float)) if types.dtype != np.int64 else np.ones(len(types), bool)
            codes = np.column_stack([np.nan_to_num(batch[c].to_numpy(zero_copy_only=False), nan=0).astype(np.int32) for c in NAMES])
            key = np.zeros(len(k), np.uint64)
            for size in range(1, ORDER + 1):
                own = (k == size) & ~context
                key[own] = key_of(codes[own][:, ORDER - size :], False)
                own = (k == size) & context  # its codes stand where those of its windows do
                key[own] = key_of(codes[own][:, ORDER - size : ORDER - 1], True)
            number = np.array([langs[x] for x in batch["lang"].to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array((key >> np.uint64(64 - bits)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(number), batch["n"], pa.array(np.where(context, np.nan_to_num(types.astype(float)), 0).astype(np.int64))],
                ["shard", "key", "lang", "n", "types"])

    return work


def _write_shard(files: Files):
    """A function for applyInArrow: sorted keys of a shard, and the languages, counts and kinds of each."""

    def write(key: tuple, table: pa.Table) -> pa.Table:
        keys, lang, n, types = (table[c].combine_chunks().to_numpy() for c in ("key", "lang", "n", "types"))
        keys = keys.view(np.uint64)
        order = np.lexsort((lang, keys))
        keys, first = np.unique(keys[order], return_index=True)
        files.put(f"shard-{key[0].as_py()}", {"keys": keys, "upto": np.append(first, len(order)).astype(np.int64), "lang": lang[order].astype(np.int32), "n": n[order], "types": types[order]})
        return pa.table({"rows": pa.array([len(order)], pa.int64())})

    return write


@dataclass
class Model:
    files: Files
    bits: int
    langs: list[str]
    discount: np.ndarray  # languages x orders
    letters: int  # distinct characters of all languages
    run_bytes: int = RUN_BYTES
    cells: int = CELLS
    curve: tuple[float, float] = (-1.0, 1.0)
    most_bits: dict[str, float] = field(default_factory=dict)


def train(docs: DataFrame, run_bytes: int = RUN_BYTES, cells: int = CELLS) -> Model:
    """The models of all languages of docs (text, lang); no calibration yet."""
    spark = docs.sparkSession
    counts = docs.where("text is not null and lang is not null").select("text", "lang").transform(mapped, _counted(run_bytes), f"lang string, {', '.join(f'{c} int' for c in NAMES)}, n long")
    grams = [written(counts.groupBy("lang", *NAMES).agg(F.sum("n").alias("n")), "lid-windows")]
    for k in range(ORDER - 1, 0, -1):
        grams.append(grams[-1].groupBy("lang", *NAMES[ORDER - k :]).agg(F.count("*").alias("n")))
    none = F.lit(None).cast("int")
    rows = None
    for k, g in zip(range(ORDER, 0, -1), grams, strict=True):
        own = NAMES[ORDER - k :]
        blank = [none.alias(c) for c in NAMES[: ORDER - k]]
        part = g.select(F.lit(k).alias("k"), "lang", *blank, *own, "n", F.lit(None).cast("long").alias("types"))
        before = g.groupBy("lang", *own[:-1]).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
        part = part.unionByName(before.select(F.lit(k).alias("k"), "lang", *blank, *own[:-1], none.alias(NAMES[-1]), "n", "types"))
        rows = part if rows is None else rows.unionByName(part)
    rows = written(rows, "lid-rows")
    sizes = rows.groupBy("lang", "k").agg(F.count("*").alias("rows"), *(F.count_if((F.col("n") == x) & F.col("types").isNull()).alias(f"n{x}") for x in (1, 2))).collect()  # languages x orders
    langs = sorted({r["lang"] for r in sizes})
    number = {x: i for i, x in enumerate(langs)}
    discount = np.full((len(langs), ORDER + 1), 0.75)
    for r in sizes:
        if r["n1"] and r["n2"]:
            discount[number[r["lang"]], r["k"]] = r["n1"] / (r["n1"] + 2 * r["n2"])
    bits = max(LEAST_BITS, math.ceil(math.log2(max(sum(r["rows"] for r in sizes) / SHARD_ROWS, 1))))
    files = Files(work_folder(spark, "lid"))
    keyed = rows.transform(mapped, _keyed(bits, number), "shard int, key long, lang int, n long, types long")
    keyed.groupBy("shard").applyInArrow(grouped(_write_shard(files)), "rows long").agg(F.sum("rows")).collect()  # one number
    letters = rows.where("k = 1 and types is null").select(F.count_distinct(NAMES[-1])).first()[0]
    return Model(files, bits, langs, discount, letters, run_bytes, cells)


class Lookup:
    """The shards in a worker, mapped when first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}
        self.forget()

    def forget(self) -> None:
        """Windows seen lately, by hash: many that are sorted, and a few more that are, too."""
        none = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)))
        self.many, self.few = none, none

    def remembered(self, hashes: np.ndarray, codes) -> np.ndarray:
        """bits() of distinct windows: hashes, and codes(places) that gives those at some places."""
        out = np.empty((len(hashes), len(self.model.langs)))
        left = np.ones(len(hashes), bool)
        for known, costs in (self.many, self.few):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                there = known[at] == hashes
                out[there] = costs[at[there]]
                left &= ~there
        new = np.flatnonzero(left)
        out[new] = self.bits(codes(new))
        few = [np.concatenate(x) for x in zip(self.few, (hashes[new], out[new]), strict=True)]
        order = few[0].argsort()
        self.few = few[0][order], few[1][order]
        if 4 * len(self.few[0]) > len(self.many[0]):
            both = [np.concatenate(x) for x in zip(self.many, self.few, strict=True)]
            order = both[0].argsort()
            self.forget()
            if both[1].size <= self.model.cells:
                self.many = both[0][order], both[1][order]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n and types of each key and language; 0 where there is none."""
        n = np.zeros((len(keys), len(self.model.langs)), np.int64)
        types = np.zeros_like(n)
        distinct, back = np.unique(keys, return_inverse=True)
        edges = np.arange(1, 1 << self.model.bits, dtype=np.uint64) << np.uint64(64 - self.model.bits)
        at = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
        found, found_types = np.zeros((len(distinct), n.shape[1]), np.int64), np.zeros((len(distinct), n.shape[1]), np.int64)
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if a == b:
                continue
            if k not in self.open:
                self.open[k] = self.model.files.map(f"shard-{k}")
            if (f := self.open[k]) is None:
                continue
            i = np.minimum(np.searchsorted(f["keys"], distinct[a:b]), len(f["keys"]) - 1)
            there = np.flatnonzero(f["keys"][i] == distinct[a:b])
            begin, size = f["upto"][i[there]], f["upto"][i[there] + 1] - f["upto"][i[there]]
            row = np.repeat(there + a, size)
            entry = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found[row, f["lang"][entry]] = f["n"][entry]
            found_types[row, f["lang"][entry]] = f["types"][entry]
        return found[back], found_types[back]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """-log2 P of the last character of each window in each language."""
        out = np.zeros((len(codes), len(self.model.langs)))
        step = max(1, self.model.cells // max(len(self.model.langs), 1))
        for a in range(0, len(codes), step):
            part = codes[a : a + step]
            p = np.full((len(part), len(self.model.langs)), 1 / (self.model.letters + 1))
            for k in range(1, ORDER + 1):
                n, _ = self.find(key_of(part[:, ORDER - k :], False))
                total, types = self.find(key_of(part[:, ORDER - k : ORDER - 1], True))
                d, some = self.model.discount[:, k], total > 0
                whole = np.maximum(total, 1)
                p = np.where(some, np.maximum(n - d, 0) / whole + d * types / whole * p, p)
            out[a : a + step] = -np.log2(p)
        return out


#: n_letters: counted characters that are letters; gap: bits by which the second language is worse, over the whole text.
SCORED = "n_letters long, best int, bits double, gap double"


def _scored(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)
        for batch in batches:
            size, langs = batch.num_rows, len(model.langs)
            bits, counted, letters = np.zeros((size, langs)), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for s in streams(batch["text"], model.run_bytes):
                hashes, at, text = windows(s)
                if not len(at):
                    continue
                counted += np.bincount(text, minlength=size)
                letters += np.bincount(text, code_points()[1][s.code[at]], size).astype(np.int64)
                if langs:
                    first, _, back = distinct(hashes)
                    costs = lookup.remembered(hashes[first], lambda new: codes_at(s, at[first[new]]))  # noqa: B023  called at once
                    costs = np.ascontiguousarray(costs.T)
                    for k in range(langs):
                        bits[:, k] += np.bincount(text, costs[k][back], size)
            if langs:
                best = bits.argmin(axis=1)
                least = bits[np.arange(size), best]
                others = bits.copy()
                others[np.arange(size), best] = np.inf
                gap = others.min(axis=1) - least if langs > 1 else np.maximum(least, 0)
                mean = least / np.maximum(counted, 1)
            else:
                best, mean, gap = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), pa.array(letters), pa.array(best.astype(np.int32)), pa.array(mean), pa.array(gap)], [*(c for c in batch.schema.names if c != "text"), "n_letters", "best", "bits", "gap"])

    return work


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns but text, and lang_pred, n_letters, bits, evidence."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    found = docs.transform(mapped, _scored(model), f"{kept}, {SCORED}")
    name = F.element_at(F.array(*map(F.lit, model.langs)), F.col("best") + 1) if model.langs else F.lit(UNKNOWN)
    return found.withColumn("lang_pred", F.when(F.col("n_letters") > 0, name).otherwise(UNKNOWN)).withColumn("evidence", F.log2(1 + F.col("gap")))


def fitted_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """a and b >= 0 of 1 / (1 + exp(-a - b * evidence)) from bins (evidence, right, wrong), with two bins of prior."""
    x, right, wrong = (np.array(c, float) for c in zip(*[*rows, (0.0, 1, 1), (8.0, 2, 0.02)], strict=True))
    a, b = 0.0, 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        n, miss = right + wrong, right - (right + wrong) * p
        w = np.maximum(n * p * (1 - p), 1e-9)
        g = np.array([miss.sum(), (miss * x).sum()]) - 1e-3 * np.array([a, b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        a, b = float(a + step[0]), max(float(b + step[1]), 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def calibrate(docs: DataFrame, model: Model) -> Model:
    """The curve and the most bits of each language, from docs (text, lang) that the models don't count."""
    found = _predicted(docs.where("text is not null and lang is not null").select("text", "lang"), model).where("n_letters > 0")
    found = written(found, "lid-calibration")
    right = F.col("lang") == F.col("lang_pred")
    # At most 8 bins for each power of two of evidence, and a row a language.
    bins = found.groupBy(F.round(F.col("evidence") * 8).alias("bin")).agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong")).collect()
    model.curve = fitted_curve([(r["bin"] / 8, r["right"], r["wrong"]) for r in bins])
    model.most_bits = {r[0]: r[1] + SLACK for r in found.where(right).groupBy("lang").agg(F.percentile_approx("bits", KEPT, 10000)).collect()}
    return model


def fit(docs: DataFrame) -> Model:
    """Models and calibration from docs (doc_id, text, lang)."""
    return calibrate(docs.where(calibrates(F.col("doc_id"))), train(docs.where(~calibrates(F.col("doc_id")))))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected, bits_per_char of each text."""
    a, b = model.curve
    found = _predicted(docs.select("doc_id", "text"), model)
    known = F.col("lang_pred") != UNKNOWN
    score = F.when(known & F.lit(bool(model.langs)), 1 / (1 + F.exp(-a - b * F.col("evidence")))).otherwise(0.0)
    most = F.lit(float("inf"))
    for name, bits in model.most_bits.items():
        most = F.when(F.col("lang_pred") == name, bits).otherwise(most)
    return found.select("doc_id", "lang_pred", score.alias("score"), (~known | (F.col("bits") > most) | (score < LEAST_SCORE)).alias("rejected"), F.col("bits").alias("bits_per_char"))


def op12_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = identify(docs, fit(docs.where(learning(F.col("doc_id"))).select("doc_id", "text", "lang")))
    return found.select("doc_id", (~learning(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected", "bits_per_char")


QUERIES = {"op12_kneser_ney_language": op12_kneser_ney_language}
ORACLE: dict[str, str] = {}
