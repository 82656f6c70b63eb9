"""Toxicity by class-conditional Kneser-Ney models.

Two models are counted from labelled texts, one of toxic and one of ordinary ones; a count
is a number of texts, so that one text that repeats itself counts once. Pairs of words
back off to words, words to stems (their first STEM bytes), and stems to counts that both
classes share: as Kneser and Ney have it, the number of contexts, here classes, that a stem is
seen in. Each level gives what it discounts to the next. So a rare expression, seen in one
class by chance, gets nearly the same probability from both and hardly moves the score,
while what is common in one class and missing in the other does, in forms not seen before as well.

A text's log-likelihoods under the two models are compared per distinct word: over the whole
text, for words and for what pairs add, and over its most toxic stretches, the one and the three
words of greatest ratio, as a few toxic words in a long text vanish in its mean. A logistic
curve of the four, fitted to labelled texts that were not counted, makes the score.

Models are fitted on a bounded sample, FIT_DOCS labelled texts of each class to count and
CALIBRATE_DOCS to fit the curve, so the model's size is bounded as well: it is broadcast.

Defined cases: a null, empty or wordless text has a log-likelihood ratio of 0 per word and
the score of that; without labelled texts of both classes every score is 0; repeated rows are scored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import WordHasher, chunks, mapped, mix64, read_documents, runs, written
from lidaraudit.llm.labelled import held_out, read_labels, sample
from lidaraudit.llm.licences import BETWEEN

FIT_DOCS = 1500
CALIBRATE_DOCS = 4000
#: Taken from each count of a pair of words, of a word and of a stem, or the whole count if less.
DISCOUNTS = (3.0, 1.0, 3.0)
STEM = 6
#: Terms of the curve.
TERMS = ("words", "pairs", "worst", "worst_three")
#: Hash of what stands before the first word.
BEGIN = np.uint64(0x2545F4914F6CDD1D)


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9FB21C651E98DF25) + b)


@dataclass
class Words:
    """The distinct words and the distinct pairs of each of several texts; doc: index of the text."""

    doc: np.ndarray
    word: np.ndarray
    stem: np.ndarray
    pair_doc: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, ends: np.ndarray, hasher: WordHasher) -> Words:
        words, counts, stems = hasher.words(data, ends, STEM)
        doc = runs(counts)
        before = np.concatenate([[BEGIN], words[:-1]]) if len(words) else words
        before[(np.cumsum(counts) - counts)[counts > 0]] = BEGIN
        once = lambda key: np.sort(np.unique(key + mix64(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1])
        one, two = once(words), once(_key(before, words))
        return cls(doc[one], words[one], stems[one], doc[two], before[two], words[two])


COUNTS = "before long, word long, stem long, toxic long, ordinary long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each pair, and with each word (before is null), by class, summed within each run of texts."""
    hasher = WordHasher(BETWEEN)
    for batch in batches:
        label = np.array(batch["label"].to_pylist())
        for a, b, data, ends in chunks(batch["text"]):
            w, toxic = Words.of(data, ends, hasher), label[a:b] == 1
            for doc, before, word, stem in ((w.pair_doc, w.before, w.after, None), (w.doc, None, w.word, w.stem)):
                _, first, number = np.unique(word if before is None else _key(before, word), return_index=True, return_inverse=True)
                sums = [np.bincount(number, c[doc], len(first)).astype(np.int64) for c in (toxic, ~toxic)]
                column = lambda x: pa.nulls(len(first), pa.int64()) if x is None else pa.array(x[first].view(np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([column(before), column(word), column(stem), *map(pa.array, sums)], [x.split()[0] for x in COUNTS.split(", ")])


def _ratio(x: list[np.ndarray]) -> np.ndarray:
    return (np.log(x[0]) - np.log(x[1])).astype(np.float32)


@dataclass
class Model:
    """Log-likelihood ratios, toxic over ordinary, in arrays sorted by hash."""

    pairs: np.ndarray
    pair_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    words: np.ndarray
    word_ratio: np.ndarray
    stems: np.ndarray
    stem_ratio: np.ndarray
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, -500.0)  # of TERMS, and of one

    @classmethod
    def of(cls, stems: pa.Table, words: pa.Table, contexts: pa.Table, pairs: pa.Table) -> Model:
        """From counts of both classes; words, contexts and pairs that nothing is left of after discounts aren't there."""
        at = lambda t, c: t[c].to_numpy().view(np.uint64)
        both = lambda t, *c: [t[x].to_numpy().astype(float) for x in c]
        order = np.argsort(at(stems, "stem"))
        stem, kinds = at(stems, "stem")[order], stems["kinds"].to_numpy()[order] + 1.0
        by_stem = [c[order] for c in both(stems, "toxic", "ordinary")]
        classes = (by_stem[0] > 0).astype(float) + (by_stem[1] > 0)
        shared = classes / max(classes.sum(), 1)
        of_stem, gamma = [], []
        for c, single in zip(by_stem, both(stems, "toxic_off", "ordinary_off"), strict=True):
            total = max(c.sum(), 1)
            off = np.minimum(c, DISCOUNTS[2])
            of_stem.append(np.maximum(c - DISCOUNTS[2], 0) / total + off.sum() / total * shared)
            gamma.append(single.sum() / total)
        order = np.argsort(at(words, "word"))
        word, s = at(words, "word")[order], np.searchsorted(stem, at(words, "stem")[order])
        of_word = [np.maximum(c[order] - DISCOUNTS[1], 0) / max(t.sum(), 1) + g * p[s] / kinds[s] for c, t, g, p in zip(both(words, "toxic", "ordinary"), by_stem, gamma, of_stem, strict=True)]
        order = np.argsort(at(contexts, "before"))
        context = at(contexts, "before")[order]
        totals = [c[order] for c in both(contexts, "toxic", "ordinary")]
        given = [np.where(t > 0, c[order] / np.maximum(t, 1), 1.0) for t, c in zip(totals, both(contexts, "toxic_off", "ordinary_off"), strict=True)]
        h, w = np.searchsorted(context, at(pairs, "before")), np.searchsorted(word, at(pairs, "word"))
        of_pair = [np.maximum(c - DISCOUNTS[0], 0) / np.maximum(t, 1)[h] + g[h] * p[w] for c, t, g, p in zip(both(pairs, "toxic", "ordinary"), totals, given, of_word, strict=True)]
        key = _key(at(pairs, "before"), at(pairs, "word"))
        order = np.argsort(key)
        return cls(key[order], _ratio(of_pair)[order], context, _ratio(given), word, _ratio(of_word), stem, _ratio([p * g for p, g in zip(of_stem, gamma, strict=True)]))

    def terms(self, data: np.ndarray, ends: np.ndarray, hasher: WordHasher) -> np.ndarray:
        """TERMS of each text."""
        out = np.zeros((len(ends), 4))
        w = Words.of(data, ends, hasher)
        if not len(w.word):
            return out

        def found(table: np.ndarray, ratio: np.ndarray, own: np.ndarray, other: np.ndarray | float) -> np.ndarray:
            if not len(table):
                return np.broadcast_to(other, len(own))
            at = np.minimum(np.searchsorted(table, own), len(table) - 1)
            return np.where(table[at] == own, ratio[at], other)

        word = lambda x, stem: found(self.words, self.word_ratio, x, found(self.stems, self.stem_ratio, stem, 0.0))
        value = word(w.word, w.stem)
        known = found(self.words, self.word_ratio, w.after, np.nan)
        pair = found(self.pairs, self.pair_ratio, _key(w.before, w.after), np.nan) - known
        pair = np.where(np.isnan(pair), found(self.contexts, self.context_ratio, w.before, 0.0), pair)
        n = np.bincount(w.doc, minlength=len(ends))
        out[:, 0] = np.bincount(w.doc, value, len(ends)) / np.maximum(n, 1)
        out[:, 1] = np.bincount(w.pair_doc, pair, len(ends)) / np.maximum(np.bincount(w.pair_doc, minlength=len(ends)), 1)
        order = np.lexsort((-value, w.doc))
        place = np.arange(len(order)) - (np.cumsum(n) - n)[w.doc[order]]
        for term, k in ((2, 1), (3, 3)):
            own = order[place < k]
            out[:, term] = np.bincount(w.doc[own], value[own], len(ends)) / np.clip(n, 1, k)
        return out

    def probability(self, terms: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(terms @ np.array(self.curve[:-1]) + self.curve[-1], -500, 500)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of y on the columns of x by Newton's method, slightly held back."""
    scale = np.maximum(x.std(0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    beta, hold = np.zeros(a.shape[1]), 0.1 * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + hold, a.T @ (y - p) - hold @ beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return (*(beta[:-1] / scale).tolist(), float(beta[-1]))


def _scored(model: Broadcast):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BETWEEN)
        for batch in batches:
            parts = [model.value.terms(data, ends, hasher) for _, _, data, ends in chunks(batch["text"])]
            terms = np.concatenate(parts) if parts else np.zeros((0, len(TERMS)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, terms.T), pa.array(model.value.probability(terms))], ["doc_id", *TERMS, "score"])

    return work


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, TERMS, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(mapped, _scored(shared), f"doc_id {kind}, " + ", ".join(f"{x} double" for x in (*TERMS, "score")))


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below least, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BETWEEN)
        for batch in batches:
            for a, b, data, ends in chunks(batch["text"]):
                keep = shared.value.probability(shared.value.terms(data, ends, hasher)) < least
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.transform(mapped, work, docs.schema)


def _tables(counted: DataFrame) -> list[DataFrame]:
    """Stems, and of words, contexts and pairs those that keep something after the discount: what isn't listed backs off whole.

    So the driver gets a small part of the counts.
    """
    classes = ("toxic", "ordinary")
    off = lambda d: [F.sum(F.least(c, F.lit(int(d)))).alias(f"{c}_off") for c in classes]
    sums = [F.sum(c).alias(c) for c in classes]
    over = lambda d: " or ".join(f"{c} > {int(d)}" for c in classes)
    words, pairs = counted.where("before is null"), counted.where("before is not null")
    return [
        words.groupBy("stem").agg(F.count("word").alias("kinds"), *sums, *off(DISCOUNTS[1])),
        words.where(over(DISCOUNTS[1])).select("word", "stem", *classes),
        pairs.groupBy("before").agg(*sums, *off(DISCOUNTS[0])).where("toxic > toxic_off or ordinary > ordinary_off"),
        pairs.where(over(DISCOUNTS[0])).select("before", "word", *classes),
    ]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", fit_docs: int = FIT_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Model:
    """The model of at most fit_docs texts of each class and calibrate_docs more of any.

    A hash of doc_id picks the texts, a quarter of those labelled for the curve. The broadcast is of at most 2 * fit_docs + calibrate_docs ids.
    """
    for_curve = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(4)) == 0
    there = dict(labels.where(~for_curve & ~held_out(F.col("doc_id"), 5)).groupBy(column).count().collect())  # a row per label
    even = max(1, min(fit_docs, there.get(0, 0), there.get(1, 0)))  # unequal corpora would make rare words speak for the larger
    counted = sample(labels.where(~for_curve), column, even, True).withColumn("use", F.lit("count"))
    rest = sample(labels.where(for_curve), column, calibrate_docs, False).withColumn("use", F.lit("curve"))
    chosen = counted.unionByName(rest).drop("order")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", "use").persist()
    counted = texts.where("use = 'count'").transform(mapped, _count, COUNTS).groupBy("before", "word").agg(F.first("stem", True).alias("stem"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    model = Model.of(*[t.toArrow() for t in _tables(written(counted, "toxicity-counts"))])
    curve = score(texts.where("use = 'curve'"), model).join(F.broadcast(chosen.where("use = 'curve'")), "doc_id").select(*TERMS, "label").toArrow()
    texts.unpersist()
    x, y = np.column_stack([curve[t].to_numpy() for t in TERMS]), curve["label"].to_numpy()
    if len(model.stems) and 0 < y.sum() < len(y):
        model.curve = _fit_curve(x, y.astype(float))
    return model


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = fit(docs, read_labels(spark, sf_dir))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_kneser_ney": op2_kneser_ney}
ORACLE: dict[str, str] = {}
