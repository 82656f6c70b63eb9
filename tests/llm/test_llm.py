"""The text operators on small inputs: defined cases, and plain versions of what they compute."""

import collections
import hashlib
import math
import random
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lidaraudit.llm import components, encoding, fingerprints, labelled, licences, lm_scoring, media, mixing, ngram_join, packing, quality, toxicity, wavelet

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omikron", "pi"]
ODD = [None, "", " ", "\n\n", "one", "One\ttwo", "x" * 5000, "äöü ß 中文 😀😀", "a  b   c \n d", "All rights  reserved. CC BY-NC; the GNU General Public License", "<|endoftext|> end", "Licensed under the MIT License\r\n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words long, key string"


def texts(seed=3, n=60):
    rng = random.Random(seed)
    out = list(ODD)
    for i in range(n):
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120)))
        out.append(base)
        if i % 4 == 0:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            out += [" ".join(w), base]
    out.append(" ".join(rng.choice(WORDS) for _ in range(30_000)))
    return out


def table(spark, own=None):
    """Odd and made-up texts, with columns whose names clash with those that operators add; two rows are repeated."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", 0, 0.5, 1, "k") for i, t in enumerate(texts() if own is None else own)]
    return spark.createDataFrame(rows + rows[4:6] if own is None else rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


# n-gram join


def plain_components(pairs, width, num, den):
    sets = {}
    for d, t in pairs:
        w = words(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


@pytest.mark.parametrize(("width", "num", "den", "tile"), [(3, 90, 100, 2048), (5, 80, 100, 2048), (2, 50, 100, 3)])
def test_join_is_exact(spark, monkeypatch, width, num, den, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(width)
    base = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(90)]
    own = [" ".join(base[:k] + ["x%d" % rng.randrange(3)] + base[k + 1 :]) for k in range(0, 60)] + [" ".join(base[: 60 + k]) for k in range(30)]
    df = table(spark, own + texts(width, 20))
    got = sorted(map(tuple, ngram_join.join(df, ngram_join.Measure(width, num, den)).collect()))
    assert got == plain_components([(r["doc_id"], r["text"]) for r in df.collect()], width, num, den)


@pytest.mark.parametrize(("width", "num", "den", "tile"), [(3, 90, 100, 2048), (5, 80, 100, 2048), (2, 50, 100, 3)])
def test_all_links_are_counted(spark, monkeypatch, width, num, den, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 300)
    rng = random.Random(width)
    base = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(90)]
    own = [" ".join(base[:k] + ["x%d" % rng.randrange(3)] + base[k + 1 :]) for k in range(0, 60, 2)] + [" ".join(base[: 60 + k]) for k in range(30)]
    own += [*own[:3], *own[:2], None, "", "one", "one"]
    df = table(spark, own)
    m = ngram_join.Measure(width, num, den)
    w = [words(t) for t in own]
    sets = [{tuple(x[i : i + width]) for i in range(len(x) - width + 1)} or ({tuple(x)} if x else set()) for x in w]
    near = lambda x, y: bool(x and y) and den * len(x & y) >= num * len(x | y)
    want = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if near(sets[a], sets[b])}
    counts = collections.Counter(d for pair in want for d in pair)
    got = ngram_join.join(df, m, count=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {d: counts[d] for d in range(len(own))} and len(got) == len(own)
    assert sorted(r[:3] for r in got) == plain_components(list(enumerate(own)), width, num, den)
    pairs, members = ngram_join.links(df, m)
    pairs, rep = sorted(map(tuple, pairs.collect())), dict(map(tuple, members.collect()))
    assert len(set(pairs)) == len(pairs)
    assert {(a, b) for a in rep for b in rep if a < b and (rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in pairs)} == want


@pytest.mark.parametrize(("block", "few"), [(2048, 24), (3, 24), (3, 1), (2048, 1)])
def test_candidates_lose_no_link(spark, monkeypatch, block, few):
    """Large groups, which are dealt to tiles, and groups that are compared one by one, on texts that share passages."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(block + few)
    passage = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(40)]
    own = []
    for _ in range(50):
        w = passage[rng.randrange(6) :] + [rng.choice(WORDS) for _ in range(rng.randrange(14))]
        w[rng.randrange(len(w))] = "x%d" % rng.randrange(4)
        own.append(" ".join(w))
    df = table(spark, own).repartition(2)
    m = ngram_join.Measure(2, 70, 100)
    assert sorted(map(tuple, ngram_join.join(df, m).collect())) == plain_components(list(enumerate(own)), 2, 70, 100)


def test_links_reach_smaller_families(spark):
    """Sets of 9 and 18 shingles, similarity 0.5: two families of sizes lie between them."""
    w = [f"w{i}" for i in range(19)]
    for num, n in ((50, 10), (20, 5)):
        got = ngram_join.join(spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:n]))], "doc_id long, text string"), ngram_join.Measure(2, num, 100)).collect()
        assert {r["component_id"] for r in got} == {1}


def test_groups_over_batches():
    """Runs of keys that go on over batches, small and large, give each group once with all its sets."""
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 40, 600)) * (rng.random(600) < 0.8)
    key.sort()
    high = rng.integers(0, 9000, 600)
    order = np.lexsort((high, key))
    key, high = key[order], high[order]
    for size in (1, 7, 600):
        batches = [pa.RecordBatch.from_pydict({"key": key[a : a + size], "high": high[a : a + size]}) for a in range(0, 600, size)]
        groups = collections.defaultdict(set)
        for b in ngram_join._groups(30)(iter(batches)):
            for g, h, large in zip(*(b[c].to_pylist() for c in ("group", "high", "large")), strict=True):
                groups[g, large].add(h)
        want = sorted((len(x), sorted(x)) for x in (set(high[key == k].tolist()) for k in set(key.tolist())) if len(x) > 1)
        assert sorted((len(x), sorted(x)) for x in groups.values()) == want


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (3, 40, 70, 150, 300)]
    sizes = np.array([len(x) for x in sets])
    maps, n = ngram_join.signatures(np.concatenate(sets), sizes)
    own = [m.view(np.uint64)[None] for m in np.split(maps, np.cumsum(n)[:-1])]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            k = min(own[i].shape[1], own[j].shape[1])
            apart = int(np.bitwise_count(ngram_join.folded(own[i], k) ^ ngram_join.folded(own[j], k)).sum())
            assert apart <= len(x) + len(y) - 2 * len(np.intersect1d(x, y)) and (i != j or apart == 0)


def test_links_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "x y z")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in ngram_join.join(df, ngram_join.Measure(3, 90, 100), count=True).collect()) == [(0, 0), (0, 0), (1, 2), (1, 2), (2, 2)]


def test_join_cases(spark, docs, empty):
    m = ngram_join.Measure(3, 90, 100)
    assert ngram_join.join(docs, m).count() == docs.count()
    assert ngram_join.join(empty, m).count() == 0
    kept = ngram_join.one_of_each(docs, m)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in plain_components([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 90, 100)})


def test_parts_leave_room_for_all_differences():
    for m in (ngram_join.Measure(3, 90, 100), ngram_join.Measure(5, 80, 100)):
        first, parts = m.families(5000)
        for a, b, (n, spare) in zip(first, [*first[1:], 10**9], parts, strict=True):
            x = b - 1 if b < 10**9 else a
            most = max((x + y) * (m.den - m.num) // (m.den + m.num) for y in (x, x * m.den // m.num))
            assert n - spare > most


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long").repartition(4)
    out = dict(map(tuple, components.components(edges).collect()))
    assert len(out) == 203 and {out[i] for i in range(201)} == {0} and out[501] == 500
    assert components.components(edges.limit(0)).count() == 0


def test_components_of_many_overlapping_groups(spark):
    """Every task sees most of one large group, and a few groups of its own: as the keys of near copies do."""
    rng = random.Random(13)
    edges = []
    for _ in range(12):
        own = [x for x in range(300) if rng.random() < 0.95]
        edges += [(own[0], x) for x in own[1:]] + [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(3)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").repartition(12)).collect()))
    assert out == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# classifiers


def labels_for(spark, df, good):
    return spark.createDataFrame([(r["doc_id"], int(good(r["text"])), int("scum" in (r["text"] or ""))) for r in df.collect()], "doc_id long, quality int, toxic int")


def judged(spark, n=900):
    rng = random.Random(7)
    own = []
    for i in range(n):
        w = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(20, 60))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "scum"
        own.append(" ".join(x.upper() + "!!" for x in w) if i % 5 == 0 else " ".join(w))
    return table(spark, own + ODD)


def accuracy(scored, labels, column, least):
    rows = scored.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id"), 5)).collect()
    return sum((r["score"] >= least) == (r[column] == 1) for r in rows) / len(rows)


def test_toxicity_on_held_out_texts(spark, empty):
    df = judged(spark)
    lower = df.withColumn("text", F.lower("text"))
    labels = labels_for(spark, lower, bool)
    model = toxicity.fit(lower, labels)
    scored = toxicity.score(lower, model)
    assert accuracy(scored, labels, "toxic", 0.5) > 0.95
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    clean = toxicity.without_toxic(lower, model)
    assert clean.columns == df.columns and clean.count() == scored.where("score < 0.5").count()
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(lower, labels.limit(0))
    assert toxicity.score(lower, none).where("score > 0.001").count() == 0


def test_quality_on_held_out_texts(spark, empty):
    df = judged(spark)
    labels = labels_for(spark, df, lambda t: "!!" not in (t or ""))
    rules = quality.fit(df, labels)
    scored = quality.score(df, rules)
    assert accuracy(scored, labels, "quality", 0.3) > 0.97
    kept = quality.of_quality(df, rules)
    assert kept.columns == df.columns and kept.count() == scored.where("score >= 0.3").count()
    assert quality.score(empty, rules).count() == 0
    assert quality.fit(df, labels.limit(0)).rules == []


def plain_terms(counted, labels_of, text):
    """Log-likelihood ratios of a text by dictionaries: pairs, words, stems and classes, each level taking what the one above discounts."""
    cut = lambda x: [w.lower() for w in re.findall(r"[0-9A-Za-z]+", x)]
    d_pair, d_word, d_stem = toxicity.DISCOUNTS
    by_class = []
    for label in (1, 0):
        own = [cut(x) for x, y in zip(counted, labels_of, strict=True) if y == label]
        by_class.append((collections.Counter(w for t in own for w in set(t)), collections.Counter(p for t in own for p in set(zip(["begin", *t], t, strict=False)))))
    stem = lambda w: w[: toxicity.STEM]
    known = {w for c, _ in by_class for w in c}
    kinds = collections.Counter(stem(w) for w in known)
    stems = [collections.Counter() for _ in by_class]
    for (c, _), s in zip(by_class, stems, strict=True):
        for w, n in c.items():
            s[stem(w)] += n
    classes = {s: sum(x[s] > 0 for x in stems) for s in kinds}

    def given(k):
        words_of, pairs_of = by_class[k]
        total = max(sum(words_of.values()), 1)
        rest = sum(min(n, d_stem) for n in stems[k].values()) / total
        p_stem = lambda s: max(stems[k][s] - d_stem, 0) / total + rest * classes[s] / max(sum(classes.values()), 1)
        gamma = sum(min(n, d_word) for n in words_of.values()) / total
        p_word = lambda w: max(words_of[w] - d_word, 0) / total + gamma * p_stem(stem(w)) / (kinds[stem(w)] + 1)
        of_context, left = collections.Counter(), collections.Counter()
        for (h, _), n in pairs_of.items():
            of_context[h] += n
            left[h] += min(n, d_pair)
        g = lambda h: left[h] / of_context[h] if of_context[h] else 1.0
        p_pair = lambda h, w: max(pairs_of[h, w] - d_pair, 0) / max(of_context[h], 1) + g(h) * p_word(w)
        return p_stem, p_word, p_pair, g, gamma

    a, b = given(1 - 1), given(1)
    ratio = lambda x, y: math.log(x) - math.log(y)

    def word(w):
        if w in known:
            return ratio(a[1](w), b[1](w))
        return ratio(a[0](stem(w)) * a[4], b[0](stem(w)) * b[4]) if stem(w) in kinds else 0.0

    own = cut(text)
    values = [word(w) for w in dict.fromkeys(own)]
    more = [ratio(a[2](h, w), b[2](h, w)) - word(w) if w in known else ratio(a[3](h), b[3](h)) for h, w in dict.fromkeys(zip(["begin", *own], own, strict=False))]
    worst = sorted(values, reverse=True)
    return [sum(values) / len(values), sum(more) / len(more), worst[0], sum(worst[:3]) / len(worst[:3])]


def test_toxicity_terms_against_dictionaries(spark):
    rng = random.Random(21)
    counted = [" ".join(rng.choice(WORDS[: 8 + 8 * (i % 2)]) + rng.choice(["", "a", "longer"]) for _ in range(rng.randrange(4, 14))) for i in range(60)]
    labels_of = [i % 2 for i in range(60)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(counted, labels_of, strict=True))], "doc_id long, text string, label int")
    table_of = df.select("text", "label").mapInArrow(toxicity._count, toxicity.COUNTS).groupBy("before", "word").agg(F.first("stem", True).alias("stem"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    model = toxicity.Model.of(*[t.toArrow() for t in toxicity._tables(table_of)])
    asked = [*counted[:10], "alpha unseen theta", "alphalonger alphazz betalonger", "zeta"]
    hasher = toxicity.WordHasher(toxicity.BETWEEN)
    for t in asked:
        got = model.terms(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), hasher)[0]
        assert np.allclose(got, plain_terms(counted, labels_of, t), atol=1e-4), t


def test_rules_score_as_they_say(spark):
    """The compiled column against the rules applied one by one to statistics of the same texts."""
    df = judged(spark, 300)
    rules = quality.fit(df, labels_for(spark, df, lambda t: "!!" not in (t or "")))
    stats = {r["doc_id"]: r for r in quality.with_statistics(df, "doc_id").collect()}
    assert rules.rules and len(rules.rules) < 200
    for r in quality.score(df, rules).collect():
        own = stats[r["doc_id"]]
        total = rules.offset + sum(w for conditions, w in rules.rules if all(own[n] <= x if most else own[n] > x for n, most, x in conditions))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_statistics_of_one_text(spark):
    r = quality.with_statistics(table(spark, ["AB ab ab\nx! x!"]), "doc_id").first()
    assert math.isclose(r["upper_share"], 2 / 14) and math.isclose(r["distinct_words"], 2 / 5) and math.isclose(r["same_neighbour"], 3 / 5) and r["n_words"] == math.log1p(5)


# mixing


def test_mix_meets_targets(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(rows[0].asDict())
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5001 and own[0]["source_size"] == sum(r["size"] for r in own)
    assert math.isclose(sum(own[0]["target"] for own in by.values()), 1.5 * sum(r["size"] for r in rows))
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(empty).count() == 0


def test_targets_stop_at_the_limit(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 40)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # 375 words: a stops at 20, of the other 355 b gets 2, c 1 and the last 5 parts, which stops at 80; then b at 2 of 3 parts.
    assert got["a"] == 20 and got[None] == 80 and math.isclose(got["b"], 275 * 2 / 3) and math.isclose(got["c"], 275 / 3)


def test_mix_keeps_columns_of_any_name(spark):
    """Names that the operator uses itself; repeated rows; extra columns come back as they were."""
    names = ["rank", "part", "bin", "p", "u", "c", "more", "copies", "before", "row", "n", "cut_bin", "own_source", "mixed_row", "taken"]
    rows = [(i, "w " * (1 + i % 5), f"s{i % 2}", *range(len(names))) for i in range(20)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mix(df).collect()
    assert len(out) == 23 and all([r[n] for n in names[:-1]] == list(range(len(names) - 1)) for r in out)
    again = mixing.sampled(df)
    assert again.columns == df.columns and all([r[n] for n in names] == list(range(len(names))) for r in again.collect())


def plain_sample(sizes, words):
    """Inclusion probabilities in proportion to size that make the expected number of words `words`, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1.0, c * s) * s for s in sizes) < words else (low, c)
    return [min(1.0, low * s) for s in sizes]


def test_mix_ranks_by_odds(spark):
    """Against the definition: ranks from probabilities found by bisection, documents in order of rank until the words are there."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 40, 90])), "ab"[i % 5 == 0]) for i in range(300)]
    out = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for source in "ab":
        own = [(i, len(t.split())) for i, t, s in rows if s == source]
        total, target = sum(n for _, n in own), out[own[0][0]]["target"]
        copies = int(target // total)
        left = more = round(target - copies * total)
        p = dict(zip([i for i, _ in own], plain_sample([n for _, n in own], more), strict=True))
        u = {i: (int(hashlib.md5(f"mix/{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for i, _ in own}
        rank = {i: 0.0 if p[i] >= 1 - 1e-12 else (u[i] / (1 - u[i])) / (p[i] / (1 - p[i])) if p[i] else math.inf for i, _ in own}
        for i, n in sorted(own, key=lambda x: (rank[x[0]], x[0])):
            assert out[i]["taken"] == copies * n + min(n, left), (source, i)
            left -= min(n, left)
        assert more == 0 or len({round(x, 9) for x in p.values()}) > 2


def test_mix_of_one_word(spark):
    for own in (["word"], ["word", "", None]):
        rows = mixing.mix(spark.createDataFrame([(i, t, "s") for i, t in enumerate(own)], "doc_id long, text string, source string")).collect()
        assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows) == [(i, int(t == "word"), 1, 1.5, 2 * int(t == "word")) for i, t in enumerate(own)]


def test_sampled_rows_are_documents(docs):
    out = mixing.sampled(docs)
    assert out.columns == docs.columns and out.groupBy("doc_id").count().where("count > 4").count() == 0


# language model


def test_lm_counts_and_probabilities(spark, docs, empty):
    model = lm_scoring.train(docs)
    out = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    own = [(r["doc_id"], [*words(r["text"]), None]) for r in docs.collect()]
    count = collections.Counter(w for _, t in own for w in t)
    n, v = sum(count.values()), len(count)
    assert (model.totals.tokens, model.totals.kinds) == (n, v)
    assert model.totals.pairs == len({p for _, t in own for p in zip(["begin", *t], t, strict=False)})
    for d, t in own:
        assert math.isclose(out[d]["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs_tol=1e-9)
        assert out[d]["n_tokens"] == len(t) == out[d]["n_known"] and out[d]["score"] < 0
    assert sum(r["score"] for r in out.values()) > sum(r["base_score"] for r in out.values())
    assert lm_scoring.score(empty, model).count() == 0
    nothing = lm_scoring.train(empty)
    assert lm_scoring.score(docs, nothing).where("score is null or n_known > 0").count() == 0


def test_lm_sums_to_one(spark):
    """After each word, the probabilities of all words, of the end and of an unknown word sum to one."""
    own = ["a b a c a b", "b a b c", "c a b", "a a c b a"]
    model = lm_scoring.train(table(spark, own))
    lookup, hasher = lm_scoring.Lookup(model), lm_scoring.WordHasher()

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return float(lookup.scores(data, np.array([len(data)]), hasher)[3][0])

    # P(h w end) = P(h) P(w|h) P(end|w) and P(w end) = P(w|begin) P(end|w), so their ratio over all w, with P(end|h), gives the sum.
    p, vocabulary = plain_kneser_ney([t.split() for t in own])
    begin = {w: p(w, "begin") for w in vocabulary}
    for h in "abc":
        total = 10 ** score(h) / begin[h]  # P(end|h)
        total += sum(10 ** (score(f"{h} {w}") - score(w)) * begin[w] / begin[h] for w in vocabulary if w)
        assert math.isclose(total, 1, rel_tol=1e-9)


def plain_kneser_ney(own):
    """P(w | h) with entries for all pairs; h and w are words, None the end, "begin" the beginning."""
    pairs = collections.Counter(p for t in own for p in zip(["begin", *t], [*t, None], strict=True))
    before = collections.Counter(h for t in own for h in ["begin", *t])
    follow = collections.Counter(w for _, w in pairs)
    by = lambda c: lm_scoring.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    off = lambda x, d: d[min(x, 3) - 1] if x else 0.0
    of_pairs, of_words = by(pairs), by(follow)
    uniform = sum(off(x, of_words) for x in follow.values()) / len(pairs)

    def p(w, h):
        word = (follow[w] - off(follow[w], of_words)) / len(pairs) + uniform / (len(follow) + 1)
        if not before[h]:
            return word
        spare = sum(off(x, of_pairs) for (a, _), x in pairs.items() if a == h) / before[h]
        return (pairs[h, w] - off(pairs[h, w], of_pairs)) / before[h] + spare * word

    return p, [*follow, "unseen"]


@pytest.fixture(scope="module")
def lm_texts():
    rng = random.Random(11)
    return [" ".join(rng.choice(WORDS[: rng.randrange(1, 16)]) for _ in range(rng.randrange(12))) for _ in range(12)]


def test_lm_is_a_plain_kneser_ney(spark, lm_texts):
    own = [t.split() for t in lm_texts]
    once = [p for p, x in collections.Counter(p for t in own for p in zip(["begin", *t], [*t, None], strict=True)).items() if x == 1]
    p, vocabulary = plain_kneser_ney(own)
    assert len(once) > 20 and all(math.isclose(sum(p(w, h) for w in vocabulary), 1) for h in ["begin", *filter(None, vocabulary)])
    # Every pair is asked for, and the plain probabilities of what may follow each word sum to one.
    asked = [*lm_texts, "pi pi unseen alpha", "other", "", *(f"{h} {w}" for h in vocabulary if h for w in vocabulary if w)]
    model = lm_scoring.train(table(spark, lm_texts))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(table(spark, asked), model).collect()}
    for d, t in enumerate(asked):
        t = t.split()
        assert math.isclose(got[d], sum(math.log10(p(w, h)) for h, w in zip(["begin", *t], [*t, None], strict=True)), abs_tol=1e-9)


def test_lm_keeps_words_apart_that_share_half_a_hash(lm_texts, monkeypatch, tmp_path):
    """All in this process, as workers would not see the changed hashes."""
    own = [t.split() for t in lm_texts]
    p, _ = plain_kneser_ney(own)
    words_of = lm_scoring.WordHasher.words

    def close(self, data, ends):
        hashes, counts = words_of(self, data, ends)
        return (hashes & lm_scoring.LOW32) | np.uint64(0x1234567800000000), counts

    monkeypatch.setattr(lm_scoring.WordHasher, "words", close)
    files, bits = lm_scoring.Files(str(tmp_path)), 4
    batch = pa.RecordBatch.from_arrays([pa.array(lm_texts)], ["text"])
    counted = pa.Table.from_batches(list(lm_scoring._count(bits)([batch])))
    taken = [lm_scoring._shard(files, bits)((k,), counted.filter(pc.equal(counted["shard"], k))) for k in pc.unique(counted["shard"])]
    t = np.sum([x["totals"][0].as_py() for x in taken], axis=0).tolist()
    rest = pa.concat_tables([x.slice(1) for x in taken])
    for k in pc.unique(rest["shard"]):
        lm_scoring._contexts(files)((k,), rest.filter(pc.equal(rest["shard"], k)))
    totals = lm_scoring.Totals(t[0], t[1], t[2], lm_scoring.discounts(t[3:7]), lm_scoring.discounts(t[7:11]))
    totals.uniform = float(np.dot(totals.of_words, [t[7], t[8], t[11]])) / totals.pairs
    lookup = lm_scoring.Lookup(lm_scoring.Model(files, bits, totals))
    data = "".join(lm_texts).encode()
    got = lookup.scores(np.frombuffer(data, np.uint8), np.cumsum([len(x.encode()) for x in lm_texts]), lm_scoring.WordHasher())[3]
    want = [sum(math.log10(p(w, h)) for h, w in zip(["begin", *x], [*x, None], strict=True)) for x in own]
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_lm_counts_past_32_bits(tmp_path):
    """Many runs with large counts of one pair and word: nothing wraps, in the file and in the sums of its first word."""
    files, word, other = lm_scoring.Files(str(tmp_path)), 5 << 40, 7 << 40
    pack = lambda kind, *v: np.array(v, kind).tobytes()
    row = {"shard": 0, "words": pack("<u8", word), "n_words": pack("<u4", 4_000_000_001), "kinds": pack("<u4", 2), "before": pack("<u8", word, other), "n_pairs": pack("<u4", 4_000_000_000, 1)}
    out = lm_scoring._shard(files, 1)((pa.scalar(0),), pa.Table.from_pylist([row, row, row]))
    lm_scoring._contexts(files)((pa.scalar(0),), out.slice(1))
    found, contexts = files.map("words-0"), files.map("contexts-0")
    assert found["n"].tolist() == [12_000_000_003] and sorted(lm_scoring.widened(found, np.arange(2)).tolist()) == [3, 12_000_000_000]
    assert dict(zip(contexts["contexts"].tolist(), contexts["total"].tolist(), strict=True)) == {word: 12_000_000_000, other: 3}


def test_discounts():
    d = lm_scoring.discounts([100, 40, 20, 12])
    y = 100 / 180
    assert np.allclose(d, (1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.6))
    assert lm_scoring.discounts([0, 0, 0, 0]) == (0.75, 0.75, 0.75)


# packing and token files


def encoded(df):
    e = encoding.encoder(encoding.default_vocabulary())
    return {r["doc_id"]: [*e.whole(r["text"] or "").tolist(), 0] for r in df.collect()}


def test_encoder_matches_the_library():
    e = encoding.Encoder(encoding.default_vocabulary())
    own = [t or "" for t in texts()] + [" lead", "trail ", "a \n b", "a\n\n  b", "a   b", "don 't", "x <|endoftext|>", "　 wide  space", "\t x\ty"]
    for _ in range(2):
        ids, n = e.encode(own)
        for t, part in zip(own, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert part.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoder_refuses_other_vocabularies():
    import os

    folder = os.path.dirname(encoding.default_vocabulary())
    with pytest.raises(ValueError, match="byte-level"):
        encoding.Encoder(os.path.join(folder, "word_bpe_49k.json"))


def test_atoms_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_ATOMS", 20)
    e, rng = encoding.Encoder(encoding.default_vocabulary()), random.Random(2)
    for _ in range(6):
        own = [" ".join(rng.choice(["été.", "x,\nYes!", "w%d" % rng.randrange(500), "don't;", "--", "a\n\nb"]) for _ in range(40)) for _ in range(20)]
        ids, n = e.encode(own)
        for t, part in zip(own, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert part.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    ids = encoded(docs)
    rows = packing.pack(docs, capacity=256).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for d, own in pieces.items():
        own.sort(key=lambda r: (r["piece"], r["start"]))
        times = sum(r["piece"] == 0 for r in own)
        assert sum(r["length"] for r in own) == times * len(ids[d]) and all(r["length"] == 256 for r in own if r["piece"] > 0)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) <= 256
    assert len(bins) <= packing.lower_bound(np.array([r["length"] for r in rows]), 256) + 2
    assert packing.pack(empty).count() == 0


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        assert packing.lower_bound(sizes, 100) <= len(packing.best_fit_decreasing(sizes.tolist(), 100)[2])
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_wavelet_matrix():
    rng = np.random.default_rng(6)
    for n in (0, 1, 511, 512, 3000):
        ids = rng.integers(0, 900, n).astype(np.uint16)
        doc_ids, lengths, m = wavelet.from_bytes(wavelet.to_bytes([5, None], np.array([n, 0]), ids))
        assert doc_ids == [5, None] and lengths.tolist() == [n, 0] and (m.tokens() == ids).all()
        for i in rng.integers(0, max(n, 1), 20) if n else []:
            assert m.access(int(i)) == ids[i]
        for t in [0, 7, 899, 60_000]:
            at = np.flatnonzero(ids == t)
            assert m.count(t) == len(at) and m.rank(t, n // 2) == (ids[: n // 2] == t).sum()
            assert [m.select(t, k) for k in range(len(at))] == at.tolist()
        with pytest.raises(IndexError):
            m.select(7, n + 1)


def test_shards(spark, docs, empty, tmp_path):
    once = docs.dropDuplicates(["doc_id"])
    ids, start = encoded(once), 0
    wavelet.write_shards(once, shard_tokens=2000, path=str(tmp_path / "out"))
    rows = sorted(wavelet.read_shards(spark.read.parquet(str(tmp_path / "out"))).collect())
    for r in rows:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert len(rows) == len(ids)
    assert wavelet.read_shards(wavelet.write_shards(docs)).count() == docs.count()
    assert wavelet.read_shards(wavelet.write_shards(empty)).count() == 0


# licences


def test_licences(spark, docs, empty):
    own = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for d in docs.collect():
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d["text"] or "").encode().lower())
        hits = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
        r = own[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licences.scan(empty).count() == 0


@pytest.mark.parametrize(("text", "label"), [
    ("Foo. Released under the MIT License. Bar", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Permission is hereby granted, free of ANY charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
])
def test_notices(spark, text, label):
    r = licences.scan(table(spark, [text, "the of and to a is under version license"])).orderBy("doc_id").collect()
    assert label in r[0]["labels"].split(",") and r[1]["labels"] == "" and r[0]["spans"][0]["label"]


GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("text", "labels"), [
    (GPL.format("General Public License", 2), "gpl,gpl-2.0"), (GPL.format("General Public License", 3), "gpl,gpl-3.0"),
    (GPL.format("Lesser General Public License", 3), "gpl,lgpl"), (GPL.format("Affero General Public License", 3), "agpl-3.0,gpl"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"), ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"), ("licensed under the public license", ""),
])
def test_licences_are_told_apart(spark, text, labels):
    assert licences.scan(table(spark, ["words before. " + text + " words after"])).first()["labels"] == labels


def test_automaton_matches():
    rng = random.Random(8)
    own = [[rng.randrange(4) for _ in range(12)] for _ in range(3)]
    a = licences.SuffixAutomaton(own)
    tokens = [rng.randrange(4) for _ in range(60)]
    inside = lambda x: [(s, e) for s, q in enumerate(own) for e in range(len(x) - 1, len(q)) if q[e - len(x) + 1 : e + 1] == x]
    longest = [max(n for n in range(i + 2) if n == 0 or inside(tokens[i + 1 - n : i + 1])) for i in range(60)]
    want = {(i, n) for i, n in enumerate(longest) if n >= 2 and (i == 59 or longest[i + 1] <= n)}
    got = list(a.matches(tokens))
    assert {(i, n) for i, n, _ in got} == want
    for i, n, state in got:
        assert sorted(a.ends[state]) == sorted(inside(tokens[i + 1 - n : i + 1]))


def test_spans_against_a_plain_matcher():
    """Texts made of pieces of notices: each span's words are those of its notice, in order, with small gaps, and as many as its share says."""
    rng = random.Random(12)
    scanner = licences.Scanner()
    own = [(label, [w.decode() for w in licences.words_of(x)]) for label, xs in licences.NOTICES.items() for x in xs]
    for _ in range(150):
        label, w = rng.choice(own)
        gone = set(rng.sample(range(len(w)), rng.choice([0, 0, 1, 2])))
        words_in = ["x%d" % rng.randrange(9) for _ in range(5)] + [v for i, x in enumerate(w) for v in ([] if i in gone else [x] + ["noise"] * (rng.random() < 0.04))] + ["end"] * 9
        data = np.frombuffer(" ".join(words_in).encode(), np.uint8)
        ((n, _, spans),) = list(scanner.scan(data, np.array([len(data)])))
        assert n == len(words_in)
        for found, first, last, share in spans:
            inside = [x.lower() for x in words_in[first : last + 1]]
            fits = []
            for name, q in [*own, *((v, k.split()) for k, v in licences.PHRASES.items())]:
                if name == found:
                    a = [x.lower() for x in q]
                    best = [[0] * (len(a) + 1) for _ in range(len(inside) + 1)]  # longest common subsequence
                    for i, x in enumerate(inside):
                        for j, y in enumerate(a):
                            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
                    fits.append(best[-1][-1] / len(a))
            assert 0 < share <= max(fits) + 1e-9
        if not gone and "noise" not in words_in:
            assert any(s[0] == label and s[3] == 1.0 for s in spans), (label, spans)


# media


def test_png_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = media.padded(bytes(i % 256 for i in range(n)))
        assert len(payload) % 192 == 0 and payload and media.from_png(media.to_png(payload)).tobytes() == payload
    broken = bytearray(media.to_png(media.padded(b"x")))
    broken[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


def test_media_of_documents(spark, docs, empty):
    stored = media.store(docs)
    pages = media.resolved(media.sequences(stored, "row"), media.features(stored), "row")
    rows = stored.select("row", "doc_id", "n_bytes").join(pages, "row").collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in rows:
        m, q = r["elements"][0]["media"], media.padded(text[r["doc_id"]])
        assert (r["n_bytes"], m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(text[r["doc_id"]]), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-16:]))
    assert media.store(empty).count() == 0


def test_pages_keep_order_and_captions(spark):
    html = "<html><script>no</script><p>One <b>two</b></p><figure><img src='sha256:aa' alt='x'><figcaption>Cap &amp; tion</figcaption></figure>three<img src='bb'><p></p><video src='sha256:cc'></video>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p")], "page_id long, html string")
    known = spark.createDataFrame([("aa", 5)], "digest string, size long")
    out = {r["page_id"]: r["elements"] for r in media.resolved(media.sequences(pages, "page_id"), known, "page_id").collect()}
    seen = [(e["position"], e["kind"], e["text"], e["digest"], e["caption"], e["media"]["size"] if e["media"] else None) for e in out[1]]
    assert seen == [(0, "text", "One two", None, None, None), (1, "image", None, "aa", "Cap & tion", 5), (2, "text", "three", None, None, None), (3, "image", None, "bb", None, None), (4, "video", None, "cc", None, None)]
    assert out[2] == []


def shown(html):
    """Visible text without its spaces, by plain replacements."""
    html = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "", html)
    return "".join(unescape(re.sub(r"(?s)<[^>]*>", "", html)).split())


def told(elements):
    return "".join("".join(((e.get("text") or "") + (e.get("caption") or "")).split()) for e in elements)


def test_captions_stand_with_their_media():
    names = lambda html: [(e["kind"], e.get("digest") or e.get("text"), e.get("caption")) for e in media.parsed(html)]
    assert names("<figure><figcaption>before</figcaption><img src=a><img src=b></figure>x") == [("image", "a", "before"), ("image", "b", "before"), ("text", "x", None)]
    assert names("<figure><img src=a><figcaption>one<p>two</figure><p>later text<figure><img src=b></figure>") == [("image", "a", "one two"), ("text", "later text", None), ("image", "b", None)]
    assert names("<figure><img src=a><figcaption>one<figure><img src=b><figcaption>two</figcaption></figure>rest") == [("image", "a", "one"), ("image", "b", "two"), ("text", "rest", None)]
    assert names("<figure><figcaption>alone</figcaption></figure><figcaption>outside") == [("text", "alone", None), ("text", "outside", None)]
    assert names("<figure><figcaption>one</figcaption><img src=a><figcaption>two</figcaption>") == [("image", "a", "one two")]
    assert names("<figure><img src=a alt=own></figure>") == [("image", "a", "own")]


def test_pages_lose_no_text(spark, small):
    """All pages as they are, then with several figures each, captions before or after their media, closed or not."""
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    for html in pages:
        assert "".join("".join((e.get("text") or "").split()) for e in media.parsed(html)) == shown(html)
    for k, html in enumerate(pages):
        blocks, want, parts = re.findall(r"(?s)<p>(?:(?!<p>).)*?</p>", html), [], []
        for n, block in enumerate(blocks):
            text, image, caption = re.sub("</?p>", "", block), f"<img src='sha256:{n}'>", None
            if (n + k) % 3 == 0:
                caption = text
                inside = [image, f"<figcaption>{text}" + "</figcaption>" * (n % 2)]
                block = "<figure>" + "".join(inside[:: -1 if n % 2 and n % 4 == 1 else 1]) + "</figure>"
                want.append((str(n), shown(caption)))
            parts.append(block)
        page = "<body>" + "<p>between</p>".join(parts) + "</body>"
        found = media.parsed(page)
        assert sorted(told(found)) == sorted(shown(page))
        assert [(e["digest"], "".join((e["caption"] or "").split())) for e in found if e["kind"] == "image"] == want
        assert [e["position"] for e in found] == list(range(len(found)))


# fingerprints


def pieces(t):
    """Runs of at most 16 words of a line that end with a sentence."""
    out = []
    for line in (t or "").split("\n"):
        own = []
        for w in line.split():
            own.append(w)
            if w[-1] in ".!?" or len(own) == fingerprints.PIECE_WORDS:
                out.append(own)
                own = []
        out += [own] if own else []
    return out


def test_fingerprints(spark, docs, empty, monkeypatch):
    once = docs.dropDuplicates(["doc_id"])
    rows = once.collect()
    order = sorted(rows, key=lambda r: -r["doc_id"])
    after = {r["doc_id"]: order[(i + 1) % len(order)]["text"] or "" for i, r in enumerate(order)}
    for per_range, coarse in ((1024, 2047), (7, 3), (1, 2047), (5, 1)):
        monkeypatch.setattr(fingerprints, "RANGE_ROWS", per_range)
        monkeypatch.setattr(fingerprints, "MOST_BOUNDS", coarse)
        pairs = {r["doc_id"]: r for r in fingerprints.with_next(once).withColumn("e", fingerprints.edited(F.col("text"), F.col("next_text"))).collect()}
        assert len(pairs) == len(rows)
        for r in rows:
            t, n = r["text"] or "", after[r["doc_id"]]
            half = len(t) // 2
            assert pairs[r["doc_id"]]["next_text"] == n and pairs[r["doc_id"]]["e"] == t[: len(t) - half] + n[:half]
        assert fingerprints.with_next(empty).count() == 0
        assert fingerprints.with_next(docs).count() == docs.count()


def test_next_of_odd_ids(spark, monkeypatch):
    """Null and repeated ids, ids far apart, and one document alone."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    rows = [(None, "n1"), (None, "n2"), (-(2**62), "low"), (2**62, "high"), (5, "a"), (5, "b"), (5, "b"), (7, "seven"), (8, None)]
    out = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    follow = {r["text"]: r["next_text"] for r in out}
    assert len(out) == 9 and follow["high"] == "" and follow[""] == "seven" and follow["seven"] in "ab" and follow["low"] in ("n1", "n2")
    assert {follow["n1"], follow["n2"]} & {"high"} and sorted(r["next_text"] for r in out) == sorted(t or "" for _, t in rows)
    assert [tuple(r)[:2] + (r["next_text"],) for r in fingerprints.with_next(spark.createDataFrame([(3, "x")], "doc_id long, text string")).collect()] == [(3, "x", "x")]


def test_many_equal_lines(spark):
    """20,000 equal lines next to a text of fewer: lanes don't wrap."""
    df = spark.createDataFrame([("same line\n" * 20_000, "same line\n" * 30 + "other line\n" * 30)], "a string, b string")
    s = df.select(*[fingerprints.state_of(F.col(c)).alias(c) for c in df.columns])
    r = s.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("l"), (fingerprints.without(fingerprints.merged(F.col("a"), F.col("b")), F.col("a")) == F.col("b")).alias("w")).first()
    assert 0.6 < r["l"] < 0.8 and r["w"]


def test_fingerprint_against_a_plain_sum(spark):
    """The lanes are sums of the bits and halves of each piece's hashes; likeness is the cosine of the +1/-1 sums."""
    texts_of = ["One two three. Four five! Six\nseven eight", "Four five! Other words here. Six", "", "a " * 40]
    df = spark.createDataFrame(list(enumerate(texts_of)), "id int, text string")
    found = {" ".join(p) for t in texts_of for p in pieces(t)}
    hashes = {r["p"]: r[1:] for r in spark.createDataFrame([(p,) for p in sorted(found)], "p string").select("p", *[F.xxhash64(F.lit(k), F.col("p")) for k in range(4)]).collect()}
    state = {r["id"]: r["s"] for r in df.select("id", fingerprints.state_of(F.col("text")).alias("s")).collect()}
    signs = {}
    for i, t in enumerate(texts_of):
        own = [[h % 2**64 for h in hashes[" ".join(p)]] for p in pieces(t)]
        want = [len(own)]
        want += [sum((h[k] >> b & 1) for h in own) + (sum((h[k] >> b + 32 & 1) for h in own) << 32) for k in (0, 1) for b in range(32)]
        want += [x % 2**32 for k in (2, 3) for x in (sum(h[k] % 2**32 for h in own), sum(h[k] >> 32 for h in own))]
        assert state[i] == want
        signs[i] = np.array([2 * sum(h[k] >> b & 1 for h in own) - len(own) for k in (0, 1) for b in range(64)], float)
    a, b = signs[0], signs[1]
    both = df.where("id < 2").agg(F.max(F.when(F.col("id") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("id") == 1, F.col("text"))).alias("b"))
    got = both.select(fingerprints.likeness(fingerprints.state_of(F.col("a")), fingerprints.state_of(F.col("b")))).first()[0]
    assert math.isclose(got, max(0.0, a @ b / math.sqrt((a @ a) * (b @ b))), abs_tol=1e-12)


def test_states_add_up(spark):
    df = spark.createDataFrame([("a b\nc d\n" + "w " * 40, "x\ny y", "x\n" + "w " * 40 + "\nc d\ny y\na b"), ("", "q", "q")], "a string, b string, both string")
    s = df.select(*[fingerprints.state_of(F.col(c)).alias(c) for c in df.columns])
    r = s.select((fingerprints.merged(F.col("a"), F.col("b")) == F.col("both")).alias("m"), (fingerprints.without(F.col("both"), F.col("b")) == F.col("a")).alias("w"), fingerprints.likeness(F.col("a"), F.col("both")).alias("l"), fingerprints.likeness(F.col("a"), F.col("a")).alias("same")).collect()
    assert all(x["m"] and x["w"] and x["same"] == 1.0 for x in r) and 0.6 < r[0]["l"] < 1 and r[1]["l"] == 0
    assert s.first()["a"][0] == len(pieces(df.first()["a"]))


# the registered queries, on whole small tables, against their contracts


@pytest.fixture(scope="module")
def rows_of(spark, small):
    from lidaraudit.llm import queries

    return lambda name: {r["doc_id"]: r for r in queries.queries()[name](spark, small).collect()}


@pytest.fixture(scope="module")
def small_texts(spark, small):
    from lidaraudit.llm.common import read_documents

    return {r["doc_id"]: r for r in read_documents(spark, small).collect()}


def remainder(d, parts):
    return zlib.crc32(str(d).encode()) % parts == 0


def test_op1_query(rows_of, small_texts):
    got = rows_of("op1_size_banded_tiles")
    assert sorted((d, r["n_shingles"], r["component_id"]) for d, r in got.items()) == plain_components([(d, r["text"]) for d, r in small_texts.items()], 3, 90, 100)


@pytest.mark.parametrize(("name", "least"), [("op2_kneser_ney", 0.5), ("op5_rule_ensemble", 0.3)])
def test_scored_queries(rows_of, small_texts, name, least):
    got = rows_of(name)
    assert set(got) == set(small_texts)
    assert all(r["held_out"] == remainder(d, 5) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least) for d, r in got.items())


def test_op4_query(rows_of, small_texts):
    got = rows_of("op4_kneser_ney_lm")
    own = {d: [*words(r["text"]), None] for d, r in small_texts.items()}
    count = collections.Counter(w for d, t in own.items() if not remainder(d, 10) for w in t)
    n, v = sum(count.values()), len(count)
    for d, t in own.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(d, 10), len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_op6_and_op9_queries(spark, small, rows_of, small_texts):
    from lidaraudit.llm import queries

    e = encoding.encoder(encoding.default_vocabulary())
    ids = {d: [*e.whole(r["text"] or "").tolist(), 0] for d, r in small_texts.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got, start = rows_of("op9_wavelet_matrix"), 0
    for d in sorted(ids):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids[d]), crc(ids[d]))
        start += len(ids[d])
    rows = queries.queries()["op6_best_fit_packing"](spark, small).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    for d, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 2048 for r in own[1:])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and sum(r["length"] for r in own) == len(ids[d])
    assert set(pieces) == set(ids)
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 1


def test_op8_and_op10_queries(rows_of, small_texts):
    media_rows, prints = rows_of("op8_interleaved_media"), rows_of("op10_multiset_hash")
    order = sorted(small_texts, reverse=True)
    for i, d in enumerate(order):
        t, n = small_texts[d]["text"] or "", small_texts[order[(i + 1) % len(order)]]["text"] or ""
        payload, r = media.padded(t.encode()), media_rows[d]
        stored = media.to_png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media._feature(np.frombuffer(payload, np.uint8).reshape(-1, media.ROW)))
        assert (r["position"], r["caption"]) == (0, f"document {d}")
        half, p = len(t) // 2, prints[d]
        edited = t[: len(t) - half] + n[:half]
        assert (p["n_chars"], p["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= p["near_edited"] <= 1 and 0 <= p["near_next"] <= 1 and p["near_next"] == (1.0 if prints[order[(i + 1) % len(order)]]["fingerprint"] == p["fingerprint"] else p["near_next"])
        assert (p["fingerprint"] == p["edited_fingerprint"]) >= (edited == t)
    same = collections.defaultdict(set)
    for d, r in small_texts.items():
        same[r["text"] or ""].add(prints[d]["fingerprint"])
    assert all(len(x) == 1 for x in same.values()) and len({f for x in same.values() for f in x}) == len({tuple(sorted(map(tuple, pieces(t)))) for t in same})


# the pipeline


@pytest.mark.parametrize("rows", [0, 12])
def test_stages_on_odd_tables(spark, small, rows):
    """An empty table; null and blank texts, repeated rows and columns whose names operators use themselves."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["own_row", "n_words", "upper_share", "rank", "part", "bin", "p", "row", "copies", "map", "high", "key", "tile", "score"]
    own = [(i % 10, [None, "", " \n", "one", "a b c d e f g", "w " * 200_000][i % 6], "en", ["s", None][i % 2], 0, *[7] * len(names)) for i in range(rows)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        found = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and all(r[n] == 7 for r in found for n in names), name
            assert len(found) <= 2 * rows


def test_pipeline_against_plain_stages(spark, small):
    """run()'s rows: by the two models' scores, brute-force groups, the copies that mix() says, and encoded ids cut and packed."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from lidaraudit.llm.common import read_documents, written

    docs, labels = read_documents(spark, small), labelled.read_labels(spark, small)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(written(stage(spark, out[-1], small), "stage"))
    assert all(x.columns == docs.columns for x in out)
    before = {r["doc_id"]: r for r in docs.collect()}
    assert all(before[r["doc_id"]] == r for x in out for r in x.collect())
    toxic = toxicity.score(docs, toxicity.fit(docs, labels))
    assert ids(out[1]) == sorted(r["doc_id"] for r in toxic.collect() if r["score"] < 0.5)
    good = quality.score(out[1], quality.fit(out[1], labels))
    assert ids(out[2]) == sorted(r["doc_id"] for r in good.collect() if r["score"] >= 0.3)
    assert ids(out[3]) == sorted(d for d, _, c in plain_components([(r["doc_id"], r["text"]) for r in out[2].collect()], 5, 80, 100) if d == c)
    copies = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix(out[3]).collect()}
    assert collections.Counter(ids(out[4])) == {d: n for d, n in copies.items() if n}
    e = encoding.encoder(encoding.default_vocabulary())
    want = []
    for d, n in copies.items():
        own = [*e.whole(before[d]["text"] or "").tolist(), 0]
        cuts = [0, *range(len(own) % 2048 or 2048, len(own) + 1, 2048)]
        want += n * [(d, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = corpus_pipeline.run(spark, small).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == sorted(want)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
