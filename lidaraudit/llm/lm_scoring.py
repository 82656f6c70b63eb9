"""LM scoring: an interpolated modified Kneser-Ney bigram model in sorted hash arrays.

Counting. Each task hashes the words of its training texts and counts distinct words and pairs
run by run; the sorted hashes and counts of a run go out as one packed value for each shard (the
high bits of a word's hash; a pair goes with its last word, as the one before it), which the shuffle groups. So all
pairs that end in one word meet in one task, which learns the exact count of each word and
pair, the number of different words before each word (continuation counts), and how many pairs
are seen 1, 2, 3 and 4 times (from which the discounts come). Shards grow in number with
the bytes of the texts (SHARD_BYTES each), so a shard fits a task's memory.

Counts are kept whole at any size: a run's own fit 32 bits, sums are 64 bits wide; a file holds
32 bits of each pair's count, and those that need more beside them.

Model. P(w|h) = (c(hw) - D(c)) / c(h) + g(h) * P(w), P(w) from continuation counts,
discounted alike and interpolated with a uniform share for words not seen. D is Chen and
Goodman's, for counts 1, 2 and above. Every pair has an entry, those seen once too; g(h) is
what the entries leave, so probabilities sum to 1.

Files. The task of a shard writes sorted arrays of word hashes with counts, and of pair hashes
with counts; a second shuffle brings together what the pairs of each first word take from it.
Workers map the files into memory and look up the distinct words and pairs of a run of texts in
sorted order. Files go to spark.checkpoint.dir; where that isn't a path, workers fetch
a shard to a temporary file, and drop it when they end.

Hashes: 64 bits for words, and so for contexts and continuation counts; for pairs 64 bits of both
words' hashes. Of n distinct ones a share of about n / 2**64 has its entry in common with another.

Defined cases: a null text is an empty one, which has one token, its end; a null doc_id is in the
training part; repeated rows count each; without training texts counts are 0 and all words
get the uniform share; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import WordHasher, chunks, grouped, mapped, mix64, read_documents, runs, work_folder, written
from lidaraudit.llm.labelled import held_out

#: Tokens of a run that is counted at once.
RUN_TOKENS = 4 << 20
#: Bytes of text for each shard, and the least number of shards as a power of two.
SHARD_BYTES, LEAST_BITS = 16 << 20, 5
#: Hashes of the end of a text, and of what stands before its first word.
END, BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
LOW32 = np.uint64(0xFFFFFFFF)
#: Counts from here on are stored apart.
LARGE = 0xFFFFFFFF
#: Multiplies the hash of a pair's last word before the other is added.
SALT = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, ends: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the one before it and itself, and how many tokens each text has (its words and one end)."""
    words, counts = hasher.words(data, ends)
    own = np.insert(words, np.cumsum(counts), END)
    counts = counts + 1
    before = np.concatenate([[BEGIN], own[:-1]])
    before[np.cumsum(counts) - counts] = BEGIN
    return before, own, counts


def pair_hash(before: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    """The shard, which is the word's, in the high bits; below it a hash of both words."""
    low = np.uint64((1 << (64 - bits)) - 1)
    return (own & ~low) | (mix64(own * SALT + before) & low)


def _distinct(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the sums of n."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(n[order], first) if len(first) else n


def _count(bits: int):
    """A function for mapInArrow: packed words and pairs of each shard."""

    def packed(own: list[np.ndarray], firsts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        words, number, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        number = number.astype(np.uint64)
        # Pairs as numbers of words in the run, the beginning after all words.
        before = np.concatenate([number[:1], number[:-1]])
        before[np.concatenate(firsts)] = len(words)
        pairs, m = np.unique(number << np.uint64(32) | before, return_counts=True)
        last, before = (pairs >> np.uint64(32)).astype(np.int64), np.append(words, BEGIN)[(pairs & LOW32).astype(np.int64)]
        at = [0, *np.searchsorted(words, edges).tolist(), len(words)]
        kinds = np.bincount(last, minlength=len(words))
        upto = np.concatenate([[0], np.cumsum(kinds)])
        rows = []
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if a < b:
                c, d = upto[a], upto[b]
                rows.append((k, words[a:b].astype("<u8").tobytes(), n[a:b].astype("<u4").tobytes(), kinds[a:b].astype("<u4").tobytes(), before[c:d].astype("<u8").tobytes(), m[c:d].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], ["shard", "words", "n_words", "kinds", "before", "n_pairs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words, firsts, size = WordHasher(), [], [], 0
        for batch in batches:
            for _, _, data, ends in chunks(batch["text"]):
                _, own, counts = tokens(data, ends, hasher)
                words.append(own)
                firsts.append(size + np.cumsum(counts) - counts)
                size += len(own)
                if size >= RUN_TOKENS:
                    yield from packed(words, firsts)
                    words, firsts, size = [], [], 0
        if size:
            yield from packed(words, firsts)

    return count


#: kinds: how many of the pairs end in each word.
PACKED = "shard int, words binary, n_words binary, kinds binary, before binary, n_pairs binary"
#: shard -1: totals of a shard in `totals`; else what pairs take from their first words.
TAKEN = "shard int, contexts binary, sums binary, taken binary, totals array<long>"


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name] if x.is_valid] or [np.zeros(0, kind)])


def narrowed(m: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as 32 bits each, and places and counts of those that need more."""
    large = np.flatnonzero(m >= LARGE)
    return {"m": np.minimum(m, LARGE).astype(np.uint32), "large_at": large, "large": m[large]}


def widened(file: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The counts at some places of what narrowed() made."""
    m = file["m"][at].astype(np.int64)
    if len(file["large_at"]):
        over = np.flatnonzero(m == LARGE)
        m[over] = file["large"][np.searchsorted(file["large_at"], at[over])]
    return m


def _shard(files: Files, bits: int):
    """A function for applyInArrow: merges a shard's words and pairs and writes its file."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        own, m = _column(table, "words", "<u8"), _column(table, "n_pairs", "<u4").astype(np.int64)
        words, n = _distinct(own, _column(table, "n_words", "<u4").astype(np.int64))
        last = np.repeat(np.searchsorted(words, own).astype(np.int32), _column(table, "kinds", "<u4"))
        before = _column(table, "before", "<u8")
        pairs = pair_hash(before, words[last], bits)
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        pairs, m = pairs[new], np.add.reduceat(m[order], new)
        last, before = last[order[new]], before[order[new]]
        follow = np.bincount(last, minlength=len(words))
        files.put(f"words-{key[0].as_py()}", {"words": words, "n": n, "follow": follow.astype(np.int64), "pairs": pairs, **narrowed(m)})
        # Of each first word: the sum of its pairs' counts, and how many are 1, 2 and above.
        first, number = np.unique(before, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, number, m)
        taken = np.column_stack([np.bincount(number, x, len(first)).astype(np.uint32) for x in (m == 1, m == 2, m > 2)])
        at = [0, *np.searchsorted(first, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(first)]
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
        totals = [int(n.sum()), len(words), len(pairs), *[int((m == k).sum()) for k in (1, 2, 3, 4)], *[int((follow == k).sum()) for k in (1, 2, 3, 4)], int((follow >= 3).sum())]
        return pa.table({
            "shard": pa.array([-1, *(k for k, _, _ in spans)], pa.int32()),
            "contexts": pa.array([None, *(first[a:b].tobytes() for _, a, b in spans)], pa.binary()),
            "sums": pa.array([None, *(sums[a:b].astype("<i8").tobytes() for _, a, b in spans)], pa.binary()),
            "taken": pa.array([None, *(taken[a:b].astype("<u4").tobytes() for _, a, b in spans)], pa.binary()),
            "totals": pa.array([totals, *(None for _ in spans)], pa.list_(pa.int64())),
        })

    return merge


def _contexts(files: Files):
    """A function for applyInArrow: sums what is taken from the first words of a shard and writes its file."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        first, taken = _column(table, "contexts", "<u8"), _column(table, "taken", "<u4").reshape(-1, 3)
        contexts, number = np.unique(first, return_inverse=True)
        total, kinds = np.zeros(len(contexts), np.int64), np.zeros((3, len(contexts)), np.int64)
        np.add.at(total, number, _column(table, "sums", "<i8"))
        for k in range(3):
            np.add.at(kinds[k], number, taken[:, k].astype(np.int64))
        files.put(f"contexts-{key[0].as_py()}", {"contexts": contexts, "total": total, "ones": kinds[0], "twos": kinds[1], "more": kinds[2]})
        return pa.table({"n": pa.array([len(contexts)], pa.int64())})

    return merge


@dataclass
class Totals:
    tokens: int = 0  # training tokens
    kinds: int = 0  # distinct ones
    pairs: int = 0  # distinct pairs
    of_pairs: tuple[float, float, float] = (0.75, 0.75, 0.75)  # discounts
    of_words: tuple[float, float, float] = (0.75, 0.75, 0.75)
    uniform: float = 1.0  # share of P(w) for words not seen


def discounts(times: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's for counts 1, 2 and above, from how many things are seen 1 to 4 times."""
    n1, n2, n3, n4 = times
    if not (n1 and n2 and n3):
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.9, 2.9), strict=True))


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]


class Files:
    """A folder that tasks write to and read from: a shared path, or any store that pyarrow reaches."""

    def __init__(self, uri: str) -> None:
        self.path = uri.removeprefix("file:").replace("//", "/") if uri.startswith(("file:", "/")) else None
        self.uri = uri

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Under a name of its own first, so a task that is run twice never leaves half a file."""
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            part = f"{self.path}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                _write(f, arrays)
            os.replace(part, f"{self.path}/{name}")
        else:
            store, base = pa.fs.FileSystem.from_uri(self.uri)
            store.create_dir(base)
            part = f"{base}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                _write(f, arrays)
            store.move(part, f"{base}/{name}")

    def map(self, name: str) -> dict[str, np.ndarray] | None:
        """None where no task has written the file: its shard has no words."""
        if self.path is not None:
            return _mapped(f"{self.path}/{name}") if os.path.exists(f"{self.path}/{name}") else None
        store, base = pa.fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(f"{base}/{name}").type == pa.fs.FileType.NotFound:
            return None
        local = tempfile.NamedTemporaryFile()  # noqa: SIM115  goes with the process
        with store.open_input_stream(f"{base}/{name}") as f:
            while block := f.read(1 << 24):
                local.write(block)
        local.flush()
        return _mapped(local.name) | {"file": local}


def _write(f, arrays: dict[str, np.ndarray]) -> None:
    """Name, type and length of each array as text, in 512 bytes; then the arrays."""
    head = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode()
    f.write(head.ljust(512))
    for a in arrays.values():
        f.write(a.tobytes())


def _mapped(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        head = f.read(512).decode().strip()
    whole, at, out = np.memmap(path, np.uint8, "r"), 512, {}
    for part in head.split(";"):
        name, kind, n = part.split(",")
        size = np.dtype(kind).itemsize * int(n)
        out[name] = whole[at : at + size].view(kind) if size else np.zeros(0, kind)
        at += size
    return out


@dataclass
class Model:
    files: Files
    bits: int
    totals: Totals


def train(docs: DataFrame) -> Model:
    """Counts the texts of docs and writes the model's files."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(LEAST_BITS, (size // SHARD_BYTES).bit_length())
    files = Files(work_folder(spark, "lm"))
    counts = docs.select("text").transform(mapped, _count(bits), PACKED)
    taken = written(counts.groupBy("shard").applyInArrow(grouped(_shard(files, bits)), TAKEN), "lm-taken")
    sums = [F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(12)]
    t = [x or 0 for x in taken.where("shard = -1").agg(*sums).first()]
    taken.where("shard >= 0").groupBy("shard").applyInArrow(_contexts(files), "n long").agg(F.sum("n")).collect()  # one number
    totals = Totals(t[0], t[1], t[2], discounts(t[3:7]), discounts(t[7:11]))
    if totals.pairs:
        d = totals.of_words
        totals.uniform = (d[0] * t[7] + d[1] * t[8] + d[2] * t[11]) / totals.pairs
    return Model(files, bits, totals)


class Lookup:
    """The model's files in a worker, mapped when first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.open = model, {}
        n = self._find("words", "words", ("n",), np.array([END]))[0]
        self.texts = int(n[0])

    def _file(self, name: str) -> dict[str, np.ndarray] | None:
        if name not in self.open:
            self.open[name] = self.model.files.map(name)
        return self.open[name]

    def _find(self, kind: str, keys: str, values: tuple[str, ...], wanted: np.ndarray) -> list[np.ndarray]:
        """Values of wanted, which are sorted; 0 where a key isn't there."""
        out = [np.zeros(len(wanted), np.int64) for _ in values]
        edges = np.arange(1, 1 << self.model.bits, dtype=np.uint64) << np.uint64(64 - self.model.bits)
        at = [0, *np.searchsorted(wanted, edges).tolist(), len(wanted)]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if a < b and (file := self._file(f"{kind}-{k}")) is not None and len(file[keys]):
                table = file[keys]
                i = np.minimum(np.searchsorted(table, wanted[a:b]), len(table) - 1)
                there = table[i] == wanted[a:b]
                for x, v in zip(out, values, strict=True):
                    x[a:b][there] = widened(file, i[there]) if v == "m" else file[v][i[there]]
        return out

    def scores(self, data: np.ndarray, ends: np.ndarray, hasher: WordHasher) -> list[np.ndarray]:
        """Of each text: n_tokens, n_known, base_score, score."""
        t = self.model.totals
        before, own, counts = tokens(data, ends, hasher)
        doc = runs(counts)
        words, w = np.unique(own, return_inverse=True)
        n, follow = self._find("words", "words", ("n", "follow"), words)
        p_word = _discounted(follow, t.of_words) / max(t.pairs, 1) + t.uniform / (t.kinds + 1)

        def left(total: np.ndarray, ones: np.ndarray, twos: np.ndarray, more: np.ndarray, n: np.ndarray) -> np.ndarray:
            """g(h): what the pairs of h leave."""
            taken = total - t.of_pairs[0] * ones - t.of_pairs[1] * twos - t.of_pairs[2] * more
            return np.where(n > 0, np.clip(1 - taken / np.maximum(n, 1), 1e-4, 1), 1.0)

        names = ("total", "ones", "twos", "more")
        gamma = left(*self._find("contexts", "contexts", names, words), n)
        gamma_begin = left(*self._find("contexts", "contexts", names, np.array([BEGIN])), np.array([self.texts]))
        starts = np.cumsum(counts) - counts
        h = np.concatenate([[0], w[:-1]])
        n_before, g = n[h].astype(float), gamma[h]
        n_before[starts], g[starts] = self.texts, gamma_begin[0]
        pairs, k = np.unique(pair_hash(before, own, self.model.bits), return_inverse=True)
        direct = _discounted(self._find("words", "pairs", ("m",), pairs)[0], t.of_pairs)[k]
        p = direct / np.maximum(n_before, 1) * (n_before > 0) + g * p_word[w]
        base = np.log10((n + 0.1) / (t.tokens + 0.1 * (t.kinds + 1)))
        size = len(ends)
        return [counts, np.bincount(doc, n[w] > 0, size).astype(np.int64), np.bincount(doc, base[w], size), np.bincount(doc, np.log10(p), size)]


def _scored(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, hasher = Lookup(model), WordHasher()
        for batch in batches:
            parts = [lookup.scores(data, ends, hasher) for _, _, data, ends in chunks(batch["text"], 4 << 20)]
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return work


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10), perplexity of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").transform(mapped, _scored(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_kneser_ney_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"), 10)))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.totals.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


QUERIES = {"op4_kneser_ney_lm": op4_kneser_ney_lm}
ORACLE: dict[str, str] = {}
