"""Ranked lexical search: items against all documents by sort-based accumulation.

Items come in blocks of at most BLOCK_ITEMS items, in number by the items' distinct terms
(BLOCK_TERMS a block, or one item that has more). One task writes a block's sorted array of
term hashes, the items of each term and, once counted, each term's weight to
spark.checkpoint.dir; workers map that file. A block takes two scans of the documents: the first
counts documents of each term, the second scores.

Scoring. In a run of documents each distinct (document, term) gives its impact to all items
of the term; these arrays are concatenated, a stable radix sort of the packed key brings equal
(item, document) pairs together, and sums of runs of equal keys are the scores. A task keeps the
best of each item in the block, so it gives out items x TOP rows at most; these are
range-partitioned by item and a heap selects the best.

A hash of 64 bits stands for a term, so of n distinct ones a share of about n / 2**64 is taken
for another.

Defined cases: null texts have no terms; an item without terms, or whose terms are in no document,
or whose weights are all 0, has no rows; items of equal item_id are one item with the terms of all; a
null item_id has no rows; documents of null doc_id count in N, L and df but aren't ranked;
repeated documents are ranked each (equal scores by doc_id); a text longer than a
run is cut between terms and its pieces are summed; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import WordHasher, bound_batches, grouped, mapped, read_documents, text_buffer, work_folder, written
from lidaraudit.llm.lm_scoring import Files

#: Bytes that are no part of a term: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`.
BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TOP = 10
#: Items of a block, whose numbers are one digit of the radix sort; distinct terms of its items together.
BLOCK_ITEMS, BLOCK_TERMS = 1 << 16, 2 << 20
#: Bytes of text of a run, and impacts that are sorted at a time.
RUN_BYTES, RUN_IMPACTS = 2 << 20, 8 << 20


class Terms:
    """Hashes of the terms of texts; capitals A-Z count as small ones."""

    def __init__(self) -> None:
        self.hasher = WordHasher(BREAKS)
        self.breaks = np.zeros(256, bool)
        self.breaks[list(BREAKS)] = True

    def pieces(self, column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of at most limit bytes (or one longer term): hashes, the text of each hash, and the texts begun so far."""
        data, borders = text_buffer(column)
        at, doc = 0, 0
        while at < len(data):
            doc = int(np.searchsorted(borders, at, "right")) - 1
            stop = min(at + limit, len(data))
            whole = int(np.searchsorted(borders, stop, "right")) - 1
            if borders[whole] > at:
                stop = int(borders[whole])
            else:  # one text is longer than the run: it is cut after a break
                end = int(borders[doc + 1])
                while stop < end:
                    cut = np.flatnonzero(self.breaks[data[at:stop]])
                    if len(cut):
                        stop = at + int(cut[-1]) + 1
                        break
                    stop = min(stop + limit, end)
            last = int(np.searchsorted(borders, stop, "left"))
            ends = np.minimum(borders[doc + 1 : last + 1], stop) - at
            hashes, counts = self.hasher.words(data[at:stop], ends)
            yield hashes, np.repeat(np.arange(doc, last), counts)
            at = stop


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        for hashes, item in terms.pieces(batch["text"]):
            order = np.lexsort((hashes, item))
            hashes, item = hashes[order], item[order]
            new = np.ones(len(item), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(item[new])), pa.array(hashes[new].view(np.int64))], ["item_id", "term"])


def _write_block(files: Files):
    """A function for applyInArrow: a block's terms, sorted, with the items of each."""

    def write(key: tuple, table: pa.Table) -> pa.Table:
        item = table["item_id"].combine_chunks().to_numpy()
        term = table["term"].combine_chunks().to_numpy().view(np.uint64)
        ids, number = np.unique(item, return_inverse=True)
        order = np.argsort(term, kind="stable")
        terms, first = np.unique(term[order], return_index=True)
        files.put(f"block-{key[0].as_py()}", {"terms": terms, "upto": np.append(first, len(order)).astype(np.int64), "items": number[order].astype(np.int64), "ids": ids})
        return pa.table({"block": key[:1]})

    return write


def _write_weights(files: Files, block: int, n_docs: int):
    """A function for applyInArrow: the weight of each term of the block, in its order."""

    def write(key: tuple, table: pa.Table) -> pa.Table:
        terms = files.map(f"block-{block}")["terms"]
        df = np.zeros(len(terms), np.int64)
        df[table["term"].combine_chunks().to_numpy()] = table["df"].combine_chunks().to_numpy()
        kinds, back = np.unique(df, return_inverse=True)
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in kinds], np.int64)
        files.put(f"weights-{block}", {"w": w[back]})
        return pa.table({"terms": pa.array([len(terms)], pa.int64())})

    return write


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first)


@dataclass
class Run:
    """Postings of whole texts: the place of each text's row, its number of terms, and (row, term, tf) by row and term."""

    n: np.ndarray
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def _postings(column: pa.Array, own: Terms, vocabulary: np.ndarray, run_bytes: int) -> Run:
    size, n_terms = len(column), max(len(vocabulary), 1)
    n, keys, counts = np.zeros(size, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for hashes, doc in own.pieces(column, run_bytes):
        n += np.bincount(doc, minlength=size)
        at = np.minimum(np.searchsorted(vocabulary, hashes), n_terms - 1)
        there = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        key, count = np.unique(doc[there] * n_terms + at[there], return_counts=True)
        keys.append(key)
        counts.append(count)
    key, tf = _sums(np.concatenate(keys), np.concatenate(counts))
    return Run(n, key // n_terms, key % n_terms, tf)


def _document_counts(files: Files, block: int, run_bytes: int):
    """A function for mapInArrow: of each term of the block (term >= 0) in how many documents it is; -1: N, -2: L."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, vocabulary = Terms(), files.map(f"block-{block}")["terms"]
        df, n_docs, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            run = _postings(batch["text"], own, vocabulary, run_bytes)
            df += np.bincount(run.term, minlength=len(df))
            n_docs, total = n_docs + int((run.n > 0).sum()), total + int(run.n.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], there])), pa.array(np.concatenate([[n_docs, total], df[there]]))], ["term", "df"])

    return work


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys in 0..most, by digits of 16 bits (numpy sorts those by radix)."""
    order, shift = np.arange(len(keys)), 0
    while most >> shift:
        digit = (keys[order] >> shift).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


class Best:
    """The TOP of each item of a block so far: scores (0: none) and doc_ids, best first."""

    def __init__(self, items: int) -> None:
        self.score, self.doc = np.zeros((items, TOP), np.int64), np.zeros((items, TOP), np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Rows of equal items stand together."""
        good = score > self.score[item, -1]
        good |= (score == self.score[item, -1]) & (doc < self.doc[item, -1]) & (score > 0)
        item, doc, score = item[good], doc[good], score[good]
        if not len(item):
            return
        for i, a, b in zip(*_spans(item), strict=True):
            rows = heapq.nsmallest(TOP, [*zip((-self.score[i]).tolist(), self.doc[i].tolist(), strict=True), *zip((-score[a:b]).tolist(), doc[a:b].tolist(), strict=True)])
            self.score[i], self.doc[i] = [-s for s, _ in rows], [d for _, d in rows]


def _spans(item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    return item[first], first, np.append(first[1:], len(item))


def accumulate(run: Run, upto: np.ndarray, items: np.ndarray, w: np.ndarray, n_docs: int, total: int, run_impacts: int = RUN_IMPACTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, row, score) of all pairs that share a term, at most run_impacts impacts (or one row's) at a time."""
    m = 10 + np.array([90 * int(x) * n_docs // max(total, 1) for x in run.n], np.int64)
    impact = w[run.term] * ((1_000_000_000 * run.tf) // (1000 * run.tf + 8 * m[run.row]))
    fan = upto[run.term + 1] - upto[run.term]
    rows = np.searchsorted(run.row, np.arange(len(run.n) + 1))  # postings of each row
    work = np.concatenate([[0], np.cumsum(fan)])[rows]
    a = 0
    while a < len(run.n):
        b = min(max(a + 1, int(np.searchsorted(work, work[a] + run_impacts, "right")) - 1), len(run.n))
        span = slice(rows[a], rows[b])
        f = fan[span]
        if f.sum():
            begin = np.repeat(upto[run.term[span]] - (np.cumsum(f) - f), f)
            item = items[begin + np.arange(f.sum())]
            width = b - a
            key = item * width + (np.repeat(run.row[span], f) - a)
            order = radix_order(key, int(key.max()))
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            score = np.add.reduceat(np.repeat(impact[span], f)[order], first)
            yield key[first] // width, key[first] % width + a, score
        a = b


def _scored(files: Files, block: int, n_docs: int, total: int, run_bytes: int, run_impacts: int):
    """A function for mapInArrow: the best documents of the task for each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = Terms(), files.map(f"block-{block}")
        w = np.asarray(files.map(f"weights-{block}")["w"])
        upto, items, best = np.asarray(found["upto"]), np.asarray(found["items"]), Best(len(found["ids"]))
        for batch in batches:
            batch = batch.filter(batch["doc_id"].is_valid())
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            run = _postings(batch["text"], own, found["terms"], run_bytes)
            for item, row, score in accumulate(run, upto, items, w, n_docs, total, run_impacts):
                best.add(item, ids[row], score)
        item, place = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(found["ids"][item]), pa.array(best.doc[item, place]), pa.array(best.score[item, place])], ["item_id", "doc_id", "score"])

    return work


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by item; a heap keeps the TOP of one item at a time."""

    def out(item: int, heap: list) -> pa.RecordBatch:
        rows = sorted(heap, reverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([item] * len(rows), pa.int64()), pa.array(range(1, len(rows) + 1), pa.int32()), pa.array([-d for _, d in rows], pa.int64()), pa.array([s for s, _ in rows], pa.int64())],
            ["item_id", "rank", "doc_id", "score"])

    now, heap = None, []
    for batch in batches:
        for item, doc, score in zip(*(batch[c].to_pylist() for c in ("item_id", "doc_id", "score")), strict=True):
            if item != now:
                if heap:
                    yield out(now, heap)
                now, heap = item, []
            (heapq.heappush if len(heap) < TOP else heapq.heappushpop)(heap, (score, -doc))
    if heap:
        yield out(now, heap)


RANKED = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS, run_bytes: int = RUN_BYTES, run_impacts: int = RUN_IMPACTS) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of each item. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    files = Files(work_folder(spark, "search"))
    pairs = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").transform(mapped, _item_terms, "item_id long, term long").distinct()
    pairs = written(pairs, "search-items")
    n_pairs, n_items = pairs.agg(F.count("*"), F.count_distinct("item_id")).first()
    blocks = max(math.ceil(n_pairs / BLOCK_TERMS), math.ceil(1.1 * n_items / block_items)) if n_pairs else 0
    if blocks > 1:  # a hash deals items out unevenly
        blocks += 1
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    there = [r[0] for r in pairs.groupBy(block.alias("block")).applyInArrow(grouped(_write_block(files)), "block long").collect()]  # a row a block
    tops = []
    for k in sorted(there):
        counts = written(docs.select("text").transform(mapped, _document_counts(files, k, run_bytes), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "search-counts")
        stats = dict(counts.where("term < 0").collect())  # two rows
        n_docs, total = stats.get(-1, 0), stats.get(-2, 0)
        counts.where("term >= 0").groupBy(F.lit(0).alias("all")).applyInArrow(_write_weights(files, k, n_docs), "terms long").collect()  # one number
        if n_docs:
            tops.append(docs.transform(mapped, _scored(files, k, n_docs, total, run_bytes, run_impacts), "item_id long, doc_id long, score long"))
    if not tops:
        return spark.createDataFrame([], RANKED)
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    found = written(found, "search-best")  # ranges are sampled before they are dealt, which would score twice
    return found.repartitionByRange("item_id").sortWithinPartitions("item_id").transform(mapped, _selected, RANKED)


def op13_sorted_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_OP13 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms
  FROM documents),
totals AS (SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000e0 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // total))))) AS BIGINT) AS score
  FROM i JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
QUERIES = {"op13_sorted_accumulation": op13_sorted_accumulation}
ORACLE = {"op13_sorted_accumulation": ORACLE_OP13}
