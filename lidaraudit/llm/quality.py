"""Quality by a sparse ensemble of rules, compiled to Spark columns.

Statistics of a text are worked out in one pass over its bytes and words (STATISTICS). A
forest of shallow trees is grown on them for labelled texts; each path from a root to a node is
a conjunctive rule. A logistic regression with an L1 penalty over the rules keeps few of them,
and those become one Spark column expression over the statistics.

The forest and the regression are fitted on a bounded sample of FIT_ROWS labelled texts.

Defined cases: a null, empty or wordless text has the statistics 0; without labelled texts of
both classes every score is the share of label 1 (0.5 without any label); repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import WordHasher, chunks, mapped, mix64, read_documents, runs
from lidaraudit.llm.labelled import held_out, read_labels, sample

FIT_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTY = 0.0005

#: Groups of bytes whose shares are statistics.
GROUPS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "blank": bytes([32, 9, 13]),
    "line_end": b"\n",
    "stop": b".,;:",
    "exclaim": b"!?",
    "symbol": b"#$%&*+/<=>@\\^_`{|}~",
    "dash": b"-|",
    "high": bytes(range(128, 256)),
}
STATISTICS = (
    "n_words", "word_bytes", *(f"{g}_share" for g in GROUPS),
    "distinct_words", "same_neighbour", "most_common", "capital_words", "odd_words", "repeated_lines", "line_words", "worst_symbol", "worst_upper", "worst_same",
)
#: Words of a stretch; the worst_ statistics are those of a text's worst stretch.
STRETCH = 32


def _statistics(data: np.ndarray, ends: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """STATISTICS of each text: bytes counted by group, words by their hashes."""
    n = len(ends)
    size = np.diff(ends, prepend=0)
    doc_of_byte = np.repeat(np.arange(n, dtype=np.int64), size)
    have = np.bincount(doc_of_byte * 256 + data, minlength=256 * n).reshape(n, 256)
    shares = [have[:, list(g)].sum(1) / np.maximum(size, 1) for g in GROUPS.values()]
    words, counts = hasher.words(data, ends)
    doc = runs(counts)
    many = np.maximum(counts, 1)
    per_doc = lambda flag: np.bincount(doc, flag, n) / many
    inside = ~hasher.space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = True
    cut[ends] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    starts = np.flatnonzero(first)
    in_word = lambda flags: np.add.reduceat(flags & inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    upper = np.zeros(256, bool)
    upper[65:91] = True
    odd = np.zeros(256, bool)
    odd[list(GROUPS["symbol"] + GROUPS["exclaim"])] = True
    uppers, odds = in_word(upper[data]), in_word(odd[data])
    key = words + mix64(doc.astype(np.uint64) + np.uint64(1))
    distinct, at, often = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, doc[at], often)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    # A line's hash is a sum over its words of hashes of word and place.
    line = np.searchsorted(np.flatnonzero(data == 10), starts) + doc
    _, where = np.unique(line, return_index=True)
    edge = np.append(where, len(words))
    order = np.arange(len(words)) - np.repeat(where, np.diff(edge))
    mixed = np.concatenate([[0], np.cumsum(mix64(words + order.astype(np.uint64)))]).astype(np.uint64)
    sums = (mixed[edge[1:]] - mixed[edge[:-1]]) + mix64(doc[where].astype(np.uint64) + np.uint64(1)) if len(words) else np.zeros(0, np.uint64)
    _, one = np.unique(sums, return_index=True)
    n_lines = np.bincount(doc[where], minlength=n)
    distinct_lines = np.bincount(doc[where[one]] if len(one) else np.zeros(0, np.int64), minlength=n)
    # Stretches of STRETCH words from the start of each text.
    rank = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    stretch = rank // STRETCH
    width = -(-counts // STRETCH)
    begin = np.cumsum(width) - width
    number = begin[doc] + stretch if len(words) else np.zeros(0, np.int64)
    total = int(width.sum())
    in_stretch = np.maximum(np.bincount(number, minlength=total), 8)
    worst = []
    for flag in (odds > 0, uppers > 1, same):
        value, top = np.bincount(number, flag, total) / in_stretch, np.zeros(n)
        np.maximum.at(top, np.repeat(np.arange(n), width), value)
        worst.append(top)
    return np.column_stack([
        np.log1p(counts), (size - have[:, [32, 9, 10, 11, 12, 13]].sum(1)) / many, *shares,
        np.bincount(doc[at], minlength=n) / many, per_doc(same), most / many, per_doc(uppers > 1), per_doc(odds > 0),
        1 - distinct_lines / np.maximum(n_lines, 1), np.log1p(counts / np.maximum(n_lines, 1)), *worst,
    ])


def with_statistics(docs: DataFrame, *kept: str) -> DataFrame:
    """The columns kept, and STATISTICS of column text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            parts = [_statistics(data, ends, hasher) for _, _, data, ends in chunks(batch["text"])]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *map(pa.array, values.T)], [*kept, *STATISTICS])

    return docs.select(*kept, "text").transform(mapped, work, ", ".join([schema, *(f"{s} double" for s in STATISTICS)]))


#: A condition: statistic, whether it must be at most (or else above) the threshold, threshold.
Condition = tuple[str, bool, float]


@dataclass
class Rules:
    """Score: logistic curve of offset and the weights of the rules that hold."""

    offset: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.offset)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: tuple[Condition, ...]) -> Column:
    held = F.lit(True)
    for name, most, threshold in rule:
        held = held & (F.col(name) <= threshold if most else F.col(name) > threshold)
    return held


def paths(tree: str) -> list[tuple[Condition, ...]]:
    """The conditions on the way to each node of a tree, read from its description."""
    found, way = [], []
    for line in tree.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            while way and way[-1][0] >= depth:
                way.pop()
            way.append((depth, (STATISTICS[int(m[2])], m[3] == "<=", float(m[4]))))
            found.append(tuple(sorted(c for _, c in way)))
    return found


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = FIT_ROWS) -> Rules:
    """Rules learnt from at most `rows` labelled texts, whose ids are broadcast."""
    chosen = sample(labels, column, rows, False)
    data = with_statistics(docs.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id"), "label").withColumn("label", F.col("label").cast("double")).persist()
    have = dict(data.groupBy("label").count().collect())  # a row per label
    if min(have.get(0.0, 0), have.get(1.0, 0)) == 0:
        share = have.get(1.0, 0) / sum(have.values()) if have else 0.5
        data.unpersist()
        return Rules(math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(data)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=1, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({p for tree in forest.trees for p in paths(tree.toDebugString)})
    flags = data.select("label", F.array(*[_holds(r).cast("double") for r in rules]).alias("flags"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(flags.select("label", array_to_vector("flags").alias("features")))
    data.unpersist()
    weights = lasso.coefficients.toArray()
    return Rules(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, score."""
    return with_statistics(docs, "doc_id").select("doc_id", rules.column().alias("score"))


def of_quality(docs: DataFrame, rules: Rules, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least least, with all their columns; nothing is shuffled."""
    rows = docs.select(F.struct(*docs.columns).alias("own_row"), "text")
    return with_statistics(rows, "own_row").where(rules.column() >= least).select("own_row.*")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    rules = fit(docs, read_labels(spark, sf_dir))
    return score(docs, rules).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op5_rule_ensemble": op5_rule_ensemble}
ORACLE: dict[str, str] = {}
