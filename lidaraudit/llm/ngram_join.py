"""N-gram Jaccard self-join: which documents are linked by the similarity of their shingle sets.

Sets are hashed to sorted arrays of 64-bit shingles. The join is exact; it has four steps.

1. Keys. Two sets of similarity at least t differ in at most d shingles, d known from their
   sizes. If the hash range is cut into more than d parts, linked sets agree in a whole part. For
   sizes in a family (FAMILY to the next) each set emits one key per part, a hash of the part's
   shingles; a set that can be linked to smaller ones of the family below emits keys for
   that as well. Parts are some more than d, so that linked sets agree in a part that isn't
   empty; a set with too many empty parts emits the keys of those, too. A passage that many
   documents share makes no common key, as their parts hold other shingles besides.
2. Candidates. Sets that share a key are a group; groups of the same sets are one. Each set has a bitmap
   signature, about one or two bits for a shingle, each shingle flipping the bit of its hash: the bits in
   which two signatures differ bound the overlap from above. Within each group the pairs that the bound lets pass
   tie their sets; a group gives a tree of ties, never all its pairs, and a group of more than BLOCK sets is
   dealt to tiles as below. So sets that only share a passage part before anything is closed:
   connected components are taken of ties that passed.
3. Tiles. A component's sets are dealt to tiles by bands of size: one tile if it has at most
   TILE sets and TILE_SHINGLES shingles, else one for each pair of blocks of the same or neighbouring bands.
   In a tile the bound of the signatures is taken again, with more bits, and all pairs that it lets
   pass are decided by exact intersection. Where only components are asked for, pairs
   whose sets are tied in the tile already are left out.
4. Components of the links, over one document for each distinct set. A document's number of links
   is the sum of the copies of the sets that its own is linked to, and its own further copies;
   so it is summed in the tiles, without a row for each pair. `links` gives the pairs themselves.

Defined cases: a null text or one without words has an empty set, no links and itself as
component; a text of fewer words than a shingle has one shingle, the whole; equal sets are linked;
repeated rows are linked to each other (doc_id is taken to name one document); rows of null doc_id
get the component of equal sets, null if there are none, and link nothing, so they have 0 links and count for none;
a repeated row counts as a link of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidaraudit.llm.common import WordHasher, chunks, grouped, mapped, mix64, read_documents, runs, written
from lidaraudit.llm.components import components, roots

FAMILY = 1.5
#: Sets, and shingles, of a block of whole sets; a tile has one or two.
TILE, TILE_SHINGLES = 2048, 1 << 21
#: Sets of a block of signatures.
BLOCK = 4096
#: Groups of at most so many sets are compared many at once.
FEW = 24
#: Shingles that are meant to be in a task's group of tiles.
BUCKET = 1 << 20
#: Shingles that are intersected at a time.
AT_ONCE = 1 << 22
SALTS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Measure:
    """Shingles of `width` words; sets are linked when intersection * den >= num * union."""

    width: int = 5
    num: int = 8
    den: int = 10

    def families(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """First size of each family, and in how many parts its sets are cut; up to size most."""
        first, parts = [1], []
        while first[-1] <= most:
            first.append(max(first[-1] + 1, math.ceil(first[-1] * FAMILY)))
        for a, b in zip(first, first[1:], strict=False):
            x = b - 1
            differ = (x + x * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
            m = differ + 1
            for _ in range(20):  # parts that may be empty in the smallest sets of the family
                empty = m * math.exp(-a / m) if m > 1 else 0.0
                more = differ + 1 + (math.ceil(empty + 4 * math.sqrt(empty)) if empty > 0.02 else 0)
                if more <= m:
                    break
                m = min(more, 2 * (differ + 1))
            parts.append((m, m - differ - 1))
        return np.array(first[:-1] or [1]), np.array(parts or [(1, 0)])


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of all texts, one after the other, and their sizes."""
    words, counts = hasher.words(data, ends)
    doc = runs(counts)
    n = len(words) - width + 1
    if n > 0:
        value = np.zeros(n, np.uint64)
        for k in range(width):
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]) if k else words[:n]
        whole = doc[:n] == doc[width - 1 :]
        value, own = value[whole], doc[:n][whole]
    else:
        value, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begins = np.cumsum(counts) - counts
        extra = np.array([_whole(words[begins[d] : begins[d] + counts[d]]) for d in short], np.uint64)
        at = np.searchsorted(own, short)
        value, own = np.insert(value, at, extra), np.insert(own, at, short)
    edges = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(ends)))])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    return value[keep], np.bincount(own[keep], minlength=len(ends))


def _whole(words: np.ndarray) -> np.uint64:
    value = np.full(1, len(words), np.uint64)
    for k in range(len(words)):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + 1])
    return value[0]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    upto = np.cumsum(sizes)
    return total[upto] - total[upto - sizes]


def set_hashes(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two words."""
    return mix64(_sums(mix64(values ^ SALTS[0]), sizes)), mix64(_sums(mix64(values ^ SALTS[1]), sizes))


def part_keys(values: np.ndarray, sizes: np.ndarray, measure: Measure) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index of the set, key) for own families, and for families below."""
    first, parts = measure.families(int(sizes.max(initial=1)))
    family = np.searchsorted(first, sizes, "right") - 1
    set_of, mixed = runs(sizes), mix64(values ^ SALTS[2])
    out, below = [], 0
    while True:
        f = family - below
        # Below: the largest set of that family can be linked to one of this size.
        use = (sizes > 0) & (f >= 0) & ((below == 0) | (sizes * measure.num <= (first[np.minimum(np.maximum(f, 0) + 1, len(first) - 1)] - 1) * measure.den))
        if not use.any():
            return out
        below += 1
        m, spare = parts[np.maximum(f, 0)].T
        m = np.where(use, m, 0)
        begin = np.cumsum(m) - m
        mine = use[set_of]
        part = begin[set_of[mine]] + ((values[mine] >> np.uint64(32)) * m[set_of[mine]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(part, minlength=int(m.sum()))
        owner = runs(m)
        place = np.arange(len(owner)) - begin[owner]
        key = mix64(_sums(mixed[mine], count) + (f[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
        empty = np.bincount(owner, count == 0, len(sizes))
        keep = (count > 0) | (empty > spare)[owner]
        out.append((owner[keep], key[keep]))


def signatures(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all sets as bytes, one after the other, and the bytes of each: a power of two, 8 at least."""
    bits = np.int64(1) << np.clip(np.ceil(np.log2(sizes + 1.0)).astype(np.int64), 6, 16)
    begin = np.cumsum(bits) - bits
    place = (mix64(values ^ SALTS[0]) & (np.repeat(bits, sizes) - 1).astype(np.uint64)).astype(np.int64) + np.repeat(begin, sizes)
    return np.packbits(np.bincount(place, minlength=int(bits.sum())) & 1, bitorder="little"), bits // 8


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) with fewer bits: a shingle's bit is the low end of its hash, so halves are added."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _info(measure: Measure):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b, data, ends in chunks(batch["text"]):
                values, sizes = shingle_sets(data, ends, measure.width, hasher)
                high, low = set_hashes(values, sizes)
                maps, n = signatures(values, sizes)
                map_of = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(maps)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(sizes), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), map_of], ["doc_id", "n_shingles", "high", "low", "map"])

    return work


def _keys(measure: Measure):
    """Keys of each set that the task hasn't seen yet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            for _, _, data, ends in chunks(batch["text"]):
                values, sizes = shingle_sets(data, ends, measure.width, hasher)
                high = set_hashes(values, sizes)[0]
                new = np.zeros(len(sizes), bool)
                for i, h in enumerate(high.tolist()):
                    if h not in seen:
                        seen.add(h)
                        new[i] = True
                values, sizes, high = values[new[runs(sizes)]], sizes[new], high[new]
                for owner, key in part_keys(values, sizes, measure):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(high[owner].view(np.int64))], ["key", "high"])

    return work


def _groups(block: int):
    """A function for mapInArrow: of rows sorted by key and set: those of keys that several sets share.

    A group is named by a hash of its sets, so equal groups have one name; a large one, which is
    handed on while it is read, by its key.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda group, high, large: pa.RecordBatch.from_arrays([pa.array(group), pa.array(high), pa.array(np.full(len(high), large))], ["group", "high", "large"])
        held_key, held, large = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            key, high = np.concatenate([held_key, batch["key"].to_numpy()]), np.concatenate([held, batch["high"].to_numpy()])
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (high[1:] != high[:-1])])
            key, high = key[new], high[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            if large:  # the first run goes on with one that was handed on in part
                end = int(first[1]) if len(first) > 1 else len(key)
                yield rows(key[1:end], high[1:end], True)  # its first row is the last one handed on
                if len(first) == 1:
                    held_key, held = key[-1:], high[-1:]
                    continue
                key, high, first, large = key[end:], high[end:], first[1:] - end, False
            last = int(first[-1])
            yield from _small_groups(key[:last], high[:last], first[:-1], rows)
            held_key, held = key[last:], high[last:]
            if len(held) > block:
                yield rows(held_key, held, True)
                held_key, held, large = held_key[-1:], held[-1:], True
        if not large:
            yield from _small_groups(held_key, held, np.zeros(min(1, len(held)), np.int64), rows)

    return work


def _small_groups(key: np.ndarray, high: np.ndarray, first: np.ndarray, rows) -> Iterator[pa.RecordBatch]:
    n = np.diff(np.append(first, len(key)))
    name = mix64(_sums(mix64(high.view(np.uint64) ^ SALTS[2]), n) + n.astype(np.uint64))
    keep = np.zeros(len(n), bool)
    keep[np.unique(name, return_index=True)[1]] = True
    keep &= n > 1
    if keep.any():
        mine = np.repeat(keep, n)
        yield rows(np.repeat(name[keep], n[keep]).view(np.int64), high[mine], False)


def _pass(measure: Measure, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of sizes x and y can be linked when their signatures differ in `apart` bits."""
    return (x + y - apart) // 2 * (measure.num + measure.den) >= measure.num * (x + y)


def _few(tile: np.ndarray, side: np.ndarray, sizes: np.ndarray, at: np.ndarray, words: np.ndarray, maps: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that pass, of tiles of at most FEW rows each; all tiles together."""
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    n = np.diff(np.append(first, len(tile)))
    left, right = [], []
    for m in np.unique(n[n > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        left.append((first[n == m][:, None] + i).ravel())
        right.append((first[n == m][:, None] + j).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    # The set with the smaller signature first.
    swap = words[a] > words[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    near = (np.minimum(sizes[a], sizes[b]) * measure.den >= np.maximum(sizes[a], sizes[b]) * measure.num) & ((side[a] == 0) | (side[a] != side[b]))
    a, b = a[near], b[near]
    apart, kind = np.zeros(len(a), np.int64), words[a] * 4096 + words[b]
    for k in np.unique(kind).tolist():
        own, x, y = np.flatnonzero(kind == k), k // 4096, k % 4096
        for part in np.array_split(own, 1 + len(own) * y // AT_ONCE):
            small = maps[at[a[part]][:, None] + np.arange(x)]
            apart[part] = np.bitwise_count(small ^ folded(maps[at[b[part]][:, None] + np.arange(y)], x)).sum(1, dtype=np.int64)
    keep = _pass(measure, sizes[a], sizes[b], apart)
    return a[keep], b[keep]


def _many(side: np.ndarray, sizes: np.ndarray, at: np.ndarray, words: np.ndarray, maps: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """A tree of the pairs of rows that pass, of one tile: sets that are tied already aren't compared again."""
    order = np.argsort(sizes, kind="stable")
    sizes, side, least = sizes[order], side[order], int(words.min())
    across = side.max() > 0
    own = np.empty((len(order), least), np.uint64)
    for i, k in enumerate(order.tolist()):
        own[i] = folded(maps[None, at[k] : at[k] + words[k]], least)[0]
    group, left, right = np.arange(len(order)), [], []
    for i in range(len(order) - 1):
        j = np.arange(i + 1, int(np.searchsorted(sizes, sizes[i] * measure.den // measure.num, "right")))
        j = j[(group[j] != group[i]) & (~across | (side[j] != side[i]))]
        if not len(j):
            continue
        j = j[_pass(measure, sizes[i], sizes[j], np.bitwise_count(own[j] ^ own[i]).sum(1, dtype=np.int64))]
        j = j[np.unique(group[j], return_index=True)[1]]
        if len(j):
            group[np.isin(group, group[j])] = group[i]
            left.append(np.full(len(j), i))
            right.append(j)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _near(measure: Measure, few_sets: int):
    """A function for mapInArrow: of signatures sorted by tile, ties of sets whose pair passes, a tree for each tile."""

    def ties(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        tile, side, sizes, high = (table[c].to_numpy() for c in ("tile", "side", "n_shingles", "high"))
        column = table["map"].combine_chunks()
        _, offsets, data = column.buffers()
        borders = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        maps = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]].copy().view(np.uint64)
        at, words = (borders[:-1] - borders[0]) // 8, np.diff(borders) // 8
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        n = np.diff(np.append(first, len(tile)))
        few = np.flatnonzero(np.repeat(n <= few_sets, n))
        a, b = _few(tile[few], side[few], sizes[few], at[few], words[few], maps, measure)
        left, right = [few[a]], [few[b]]
        for k in np.flatnonzero(n > few_sets).tolist():
            rows = np.arange(first[k], first[k] + n[k])
            a, b = _many(side[rows], sizes[rows], at[rows], words[rows], maps, measure)
            left.append(rows[a])
            right.append(rows[b])
        nodes, root = roots(np.concatenate(left), np.concatenate(right))
        pairs = np.unique(np.column_stack([high[root], high[nodes]])[root != nodes], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch["tile"].to_numpy()
            last = int(np.flatnonzero(tile != tile[-1])[-1]) + 1 if tile[0] != tile[-1] else 0
            if held and (last or tile[0] != held[-1]["tile"][-1].as_py()):
                yield from ties(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield from ties(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield from ties(pa.Table.from_batches(held))

    return work


def tile_links(sizes: np.ndarray, values: np.ndarray, side: np.ndarray, measure: Measure, every: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Links of the sets of a tile: a set and those of its links that come after it by size.

    Sides 1 and 2 are two blocks, and only pairs across them count; side 0 is a tile of one block.
    Unless every link is asked for, pairs that links tie already are left out.
    """
    order = np.lexsort((values[np.cumsum(sizes) - sizes], sizes))
    begin = (np.cumsum(sizes) - sizes)[order]
    sizes, side = sizes[order], side[order]
    across = side.max() > 0
    bits = 1 << max(6, min(16, int(2 * sizes.max()).bit_length()))
    maps = np.zeros((len(sizes), bits // 8), np.uint8)
    for i, (a, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
        maps[i] = np.packbits(np.bincount((mix64(values[a : a + n] ^ SALTS[0]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)
    maps = maps.view(np.uint64)
    kinds, number = np.unique(values, return_inverse=True)
    number = number.astype(np.int32)
    sets = [number[a : a + n] for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
    mine, group = np.zeros(len(kinds), np.uint8), np.arange(len(sizes))
    for i in range(len(sizes) - 1):
        # 100 * |x and y| >= 90 * |x or y| needs 90 * |y| <= 100 * |x|.
        past = int(np.searchsorted(sizes, sizes[i] * measure.den // measure.num, "right"))
        j = np.arange(i + 1, past)
        j = j[(every | (group[j] != group[i])) & (~across | (side[j] != side[i]))]
        if not len(j):
            continue
        j = j[_pass(measure, sizes[i], sizes[j], np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64))]
        if not len(j):
            continue
        mine[sets[i]] = 1
        both = []
        for part in np.array_split(j, min(len(j), 1 + int(sizes[j].sum()) // AT_ONCE)):
            n = sizes[part]
            both.append(np.add.reduceat(mine[np.concatenate([sets[k] for k in part.tolist()])], np.cumsum(n) - n, dtype=np.int64))
        mine[sets[i]] = 0
        j = j[np.concatenate(both) * (measure.num + measure.den) >= measure.num * (sizes[i] + sizes[j])]
        if not every:  # one link to each group
            j = j[np.unique(group[j], return_index=True)[1]]
        if len(j):
            group[np.isin(group, group[j])] = group[i]
            yield int(order[i]), order[j]


def _tiles(measure: Measure, want: str):
    """Of the tiles' links, as `want` says: "ties", enough of them for the components (a, b, 0); "counts",
    the same and the links of each set, weighed by copies (rep, high, number); "pairs", all (a, b, 0)."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hasher, out = WordHasher(), [np.zeros((0, 3), np.int64)]
        for _, own in rows.groupby("tile"):
            column, values, sizes = pa.array(own["text"]), [], []
            for _, _, data, ends in chunks(column):
                v, n = shingle_sets(data, ends, measure.width, hasher)
                values.append(v)
                sizes.append(n)
            v, n = np.concatenate(values), np.concatenate(sizes)
            # Of rows that share a doc_id, the one whose set is meant.
            keep = (set_hashes(v, n)[0].view(np.int64) == own["high"].to_numpy()) & ~own.duplicated(["rep", "high"]).to_numpy()
            rep, high, copies = (own[c].to_numpy()[keep] for c in ("rep", "high", "copies"))
            counts, group = np.zeros(len(rep), np.int64), np.arange(len(rep))
            for i, j in tile_links(n[keep], v[keep[runs(n)]], own["side"].to_numpy()[keep], measure, want != "ties") if len(rep) else ():
                counts[i] += copies[j].sum()
                counts[j] += copies[i]
                if want == "counts":  # a forest for the components
                    j = j[group[j] != group[i]]
                    j = j[np.unique(group[j], return_index=True)[1]]
                    group[np.isin(group, group[j])] = group[i]
                out.append(np.column_stack([np.full(len(j), rep[i]), rep[j], np.zeros(len(j), np.int64)]))
            if want == "counts":
                some = counts > 0
                out.append(np.column_stack([rep[some], high[some], counts[some]]))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b", "n"])

    return work


def _dealt(members: DataFrame, measure: Measure, sets: int, shingles: int) -> DataFrame:
    """tile, side and the columns of members, but for its component: a row for each tile that a set is in.

    members: high, n_shingles, component and more. Linked sizes are in the same or in neighbouring bands.
    A component of at most so many sets and shingles is one tile; in others blocks have about as many.
    """
    kept = [c for c in members.columns if c != "component"]
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(measure.den / measure.num) + 1e-9).cast("int")
    members = members.withColumn("band", band)
    per_band = members.groupBy("component", "band").agg((F.greatest(F.count("high") / sets, F.sum("n_shingles") / shingles)).alias("n"))
    whole = per_band.groupBy("component").agg(F.sum("n").alias("all"))
    blocks = per_band.join(whole, "component").where("all > 1").select("component", "band", F.ceil("n").cast("int").alias("blocks"))
    up = blocks.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    down = blocks.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    blocks = written(blocks.join(up, ["component", "band"], "left").join(down, ["component", "band"], "left"), "blocks")
    large = members.join(blocks, ["component", "band"], "left")
    block = F.pmod(F.xxhash64("high"), F.col("blocks")).cast("int")
    to = lambda n: F.when(n.isNull() | (n < 1), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    name = lambda band, x, over, y: F.xxhash64("component", band, x, over, y)
    cell = lambda tile, side: F.struct(tile.alias("tile"), F.lit(side).alias("side"))
    inside = F.transform(to(F.col("blocks")), lambda k: F.struct(name(F.col("band"), F.least(k, F.col("block")), F.lit(0), F.greatest(k, F.col("block"))).alias("tile"), F.when(k == F.col("block"), 0).when(k < F.col("block"), 2).otherwise(1).alias("side")))
    above = F.transform(to(F.col("above")), lambda k: cell(name(F.col("band"), F.col("block"), F.lit(1), k), 1))
    below = F.transform(to(F.col("below")), lambda k: cell(name(F.col("band") - 1, k, F.lit(1), F.col("block")), 2))
    alone = F.array(cell(F.xxhash64("component"), 0))
    cells = F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(inside, above, below))
    return large.withColumn("block", block).select(*kept, F.explode(cells).alias("cell")).select("cell.*", *kept)


def _candidates(docs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """node (high), component: sets that ties connect which the bound of signatures lets pass."""
    keys = docs.transform(mapped, _keys(measure), "key long, high long")
    groups = written(keys.repartition("key").sortWithinPartitions("key", "high").transform(mapped, _groups(BLOCK), "group long, high long, large boolean"), "groups")
    shared = groups.where("not large").select(F.col("group").alias("tile"), F.lit(0).alias("side"), "high").distinct()
    large = groups.where("large").select(F.col("group").alias("component"), "high").distinct()
    signed = sets.select("high", "n_shingles", "map")
    if large.head(1):
        # Large groups of the same sets are compared once.
        name = large.groupBy("component").agg(F.count("high").alias("n"), F.bit_xor(F.xxhash64("high")).alias("x"))
        once = name.groupBy("n", "x").agg(F.min("component").alias("component")).select("component")
        dealt = _dealt(large.join(once, "component", "left_semi").join(signed.drop("map"), "high"), measure, BLOCK, BLOCK << 12)
        shared = shared.unionByName(dealt.select("tile", "side", "high"))
    tiles = shared.join(signed, "high").repartition("tile").sortWithinPartitions("tile")
    return components(tiles.transform(mapped, _near(measure, FEW), "a long, b long"))


def _linked(docs: DataFrame, measure: Measure, want: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sets of all rows, a representative and the copies of each distinct set, and what _tiles gives."""
    docs = docs.select("doc_id", "text")
    info = written(docs.transform(mapped, _info(measure), "doc_id long, n_shingles long, high long, low long, map binary"), "sets")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "map")]
    reps = written(info.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep"), *firsts, F.count("doc_id").alias("copies")), "reps")
    candidates = _candidates(docs, reps, measure)
    members = reps.select("rep", "high", "copies", "n_shingles").join(candidates, reps.high == candidates.node).drop("node")
    tiles = written(_dealt(members, measure, TILE, TILE_SHINGLES), "tiles")
    buckets = max(1, (tiles.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET)
    # The hint keeps one plan at all sizes: texts move once, to the tasks that hold the tiles' ids.
    filled = docs.join(tiles.hint("shuffle_hash"), tiles.rep == docs.doc_id).select("tile", "side", "rep", "high", "copies", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("tile"), F.lit(buckets)).alias("bucket"))
    return info, reps, filled.groupBy("bucket").applyInPandas(grouped(_tiles(measure, want)), "a long, b long, n long")


def join(docs: DataFrame, measure: Measure = Measure(), count: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (least doc_id that links lead to); with count n_links, the number of other rows that are linked to the row."""
    info, reps, found = _linked(docs, measure, "counts" if count else "ties")
    if count:
        found = written(found, "links")
        sums = found.where("n > 0").groupBy(F.col("a").alias("rep"), F.col("b").alias("high")).agg(F.sum("n").alias("others"))
        reps = reps.join(sums, ["rep", "high"], "left")
    linked = components(found.where("n = 0"), shrink=False)
    links = [(F.col("copies") + F.coalesce("others", F.lit(0))).alias("n_links")] if count else []
    classes = reps.join(linked, reps.rep == linked.node, "left").select("high", "low", F.coalesce("component", "rep").alias("component_id"), *links)
    kept = ["doc_id", "n_shingles", "component_id"]
    own = [F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("n_links") - 1).cast("long").alias("n_links")] if count else []
    whole = info.where("n_shingles > 0").join(classes, ["high", "low"]).select(*kept, *own)
    none = [F.lit(0).cast("long").alias("n_links")] if count else []
    return whole.unionByName(info.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *none))


def links(docs: DataFrame, measure: Measure = Measure()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """All pairs a-b of linked representatives, once each, and doc_id, rep: whom each document with words is represented by.

    Documents are linked if they have one representative or if theirs are linked.
    """
    info, reps, found = _linked(docs, measure, "pairs")
    pairs = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, info.where("n_shingles > 0").join(reps.select("high", "low", "rep"), ["high", "low"]).select("doc_id", "rep")


def one_of_each(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:  # noqa: B008
    """The rows of docs whose doc_id is the least of its component, once each; rows of null doc_id stay."""
    found = join(docs, measure)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def op1_size_banded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_documents(spark, sf_dir), Measure(3, 90, 100), count=True)


QUERIES = {"op1_size_banded_tiles": op1_size_banded_tiles}
ORACLE: dict[str, str] = {}
