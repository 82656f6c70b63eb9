"""The prefix trie, language ID and ranked search: against plain versions, over odd tables, in many partitions and blocks."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lidaraudit.llm import language_id, prefix_trie, search

# Prefix trie


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = set()
    for p, own in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        children = [q for q in inside if len(q) == len(p) + 1]
        leaves = [q for q in inside if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in inside)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in inside)
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(p))
        out.add((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn int, role string, text string, units string, prefix int, n_convs int"


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, n):
        for k in range(rng.choice([0, 1, 2, 3, 4, 6, 12])):
            rows.append((c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello", "", None, "ünïcödé 😀", "hi"])))
    rows += rows[3:6] + [(None, 0, "user", "nobody's")]
    rows += [(2000 + k, t, "user", f"same {t}") for k in range(60) for t in range(3)]  # a hot first turn and equal conversations
    rows += [(5000, k, "user", str(k % 7)) for k in range(400)]  # a long one
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_trie_against_a_plain_one(spark, parts):
    rows = conversations(parts, 70)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], TURNS).repartition(3)
        got = [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(turns), piece_bytes=100).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got))
    assert set(got) == plain_trie(rows)


def test_trie_cases(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    # A conversation whose own turns are all replaced by those of an absent base has none left.
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    got = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([(c, 0, "user", "x" * 300_000, "", 0, 0), (None, 0, "a", "b", "", 0, 0)], TURNS))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_common_units():
    rng = random.Random(1)
    for _ in range(300):
        a = b"".join(bytes([rng.randrange(2)]) * prefix_trie.UNIT for _ in range(rng.randrange(6)))
        b = b"".join(bytes([rng.randrange(2)]) * prefix_trie.UNIT for _ in range(rng.randrange(6)))
        n = 0
        while n < min(len(a), len(b)) // prefix_trie.UNIT and a[n * 24] == b[n * 24]:
            n += 1
        assert prefix_trie.common_units(a, b) == n


@pytest.mark.parametrize("module", [prefix_trie, search])
def test_queries_match_their_sql(spark, small, module):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name, query in module.QUERIES.items():
        got, want = query(spark, small), con.sql(module.ORACLE[name])
        order = sorted(want.columns)
        assert sorted(got.columns) == order
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.select(*order).collect()), key=key) == sorted((tuple(r) for r in want.select(*order).fetchall()), key=key)


# Language ID


def made_up(lang, rng, n):
    sounds = {"aa": "ka la ma tu ni", "bb": "sch ein und ach", "cc": "żółć ęcie ść nie"}[lang].split()
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(1, 4))) for _ in range(n))


LANGS = "doc_id long, text string, lang string, best int, bits string, n int"


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(5)
    rows = [(i, made_up(x, rng, rng.randrange(1, 60)), x if i % 50 else None, 1, "", 2) for i, x in enumerate(["aa", "bb", "cc"] * 120)]
    return [*rows, (900, None, "aa", 1, "", 2), (901, "", "bb", 1, "", 2), (902, " 12 , ́", "cc", 1, "", 2), (None, "ka la", "aa", 1, "", 2), (903, made_up("bb", rng, 40_000), "bb", 1, "", 2), rows[7], rows[7]]


def normal(t):
    out = " " + "".join(c.lower() if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in t or "") + " "
    return re.sub(" +", " ", out)


def plain_models(rows):
    """Interpolated Kneser-Ney of characters, by dictionaries."""
    grams = collections.defaultdict(collections.Counter)
    for t, x in rows:
        if t is None or x is None:
            continue
        s = normal(t)
        for i in range(1, len(s)):
            grams[x][(" " * 4 + s)[i : i + 5]] += 1
    letters = {g[-1] for c in grams.values() for g in c}
    out = {}
    for x, top in grams.items():
        by = {5: top}
        for k in (4, 3, 2, 1):
            by[k] = collections.Counter(g[1:] for g in by[k + 1])
        tables = {}
        for k, c in by.items():
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            total, kinds = collections.Counter(), collections.Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            tables[k] = (c, n1 / (n1 + 2 * n2) if n1 and n2 else 0.75, total, kinds)
        out[x] = tables
    return out, len(letters)


def plain_bits(tables, letters, text):
    s, total = "    " + normal(text), 0.0
    for i in range(5, len(s)):
        p = 1 / (letters + 1)
        for k in range(1, 6):
            g = s[i - k + 1 : i + 1]
            c, d, sums, kinds = tables[k]
            if sums[g[:-1]]:
                p = max(c[g] - d, 0) / sums[g[:-1]] + d * kinds[g[:-1]] / sums[g[:-1]] * p
        total -= math.log2(p)
    return total


def test_language_models_are_plain_kneser_ney(spark, spoken):
    df = spark.createDataFrame(spoken, LANGS).repartition(3)
    model = language_id.train(df, run_bytes=3000, cells=5000)  # the long text comes in pieces
    models, letters = plain_models([(r[1], r[2]) for r in spoken])
    assert model.langs == sorted(models) and model.letters == letters
    got = language_id._predicted(df.select("doc_id", "text"), model).collect()
    texts = {r[0]: r[1] for r in spoken}
    for r in got:
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert r["lang_pred"] == "und" and r["n_letters"] == 0
            continue
        bits = sorted((plain_bits(models[x], letters, texts[r["doc_id"]]), x) for x in models)
        n = len(normal(texts[r["doc_id"]])) - 1
        assert r["bits"] * n == pytest.approx(bits[0][0], rel=1e-9)
        assert 2 ** r["evidence"] - 1 == pytest.approx(bits[1][0] - bits[0][0], rel=1e-6, abs=1e-6)
        if bits[1][0] - bits[0][0] > 1e-6:
            assert r["lang_pred"] == bits[0][1]


def test_language_cases(spark, spoken):
    df = spark.createDataFrame(spoken, LANGS).repartition(2)
    model = language_id.fit(df.where(language_id.learning(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for i in (900, 901, 902):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    langs = {r[0]: ["aa", "bb", "cc"][r[0] % 3] for r in spoken if r[0] is not None and r[0] < 900}
    wrong = [i for i, x in langs.items() if got[i]["lang_pred"] != x]
    assert len(wrong) <= 5 and all(0 <= r["score"] <= 1 for r in got.values())
    rest = [got[i]["score"] for i in langs if i not in wrong]
    assert np.mean(rest) > 0.9
    other = spark.createDataFrame([(1, "привет как дела это другой язык", None, 1, "", 2), (2, "12 34", None, 1, "", 2)], LANGS)
    assert {r["rejected"] for r in language_id.identify(other, model).collect()} == {True}
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.fit(df.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(df, none).collect()} == {("und", 0.0)}
    one = language_id.fit(df.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_id.identify(df, one).collect()} == {"aa", "und"}


def test_curve_follows_the_bins():
    rng = random.Random(2)
    rows = []
    for k in range(40):
        p = 1 / (1 + math.exp(1 - 0.8 * k / 8))
        right = sum(rng.random() < p for _ in range(5000))
        rows.append((k / 8, right, 5000 - right))
    a, b = language_id.fitted_curve(rows)
    assert abs(a + 1) < 0.1 and abs(b - 0.8) < 0.1
    assert language_id.fitted_curve([])[1] > 0


def test_language_query_on_held_out(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = language_id.QUERIES["op12_kneser_ney_language"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


# Ranked search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def plain_search(docs, items):
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in own:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total))) for t in ts if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:10], 1) if item is not None]
    return out


DOCS = "doc_id long, text string, item_id long, score long, term long"


@pytest.mark.parametrize("small_runs", [False, True])
def test_search_against_a_plain_one(spark, small_runs):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Éa", "ñ", "x1", "日本", "AND", "and", *(f"w{k}" for k in range(300))]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary[: rng.choice([5, 30, 300])]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(-5, 200)]
    docs += [(300, None), (301, ""), (302, "?! ,"), (303, text(3000)), (None, "the w1 w2"), docs[9], docs[9], (304, "the"), (305, "the")]
    items = [(i, text(rng.randrange(1, 25))) for i in range(30)] + [(30, None), (31, "unknown words"), (32, "the"), (3, "w7 w8"), (None, "the"), (33, "THE the w1")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in search.search(df, asked, **({"block_items": 12, "run_bytes": 100, "run_impacts": 50} if small_runs else {})).collect()]
    assert sorted(got) == sorted(plain_search(docs, items))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert search.search(docs, items).count() == 0
    full = spark.createDataFrame([(1, "the", 1, 2, 3)], DOCS)
    assert search.search(full, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.search(full, items).collect()] == [(1, 1, 1)]


def test_pieces_cut_between_terms():
    texts = ["alpha beta", "", "x" * 50, None, "one two three four five six", " ", "äöü-ß 1"]
    for limit in (1, 7, 20, 1000):
        found = collections.defaultdict(list)
        for hashes, doc in search.Terms().pieces(pa.array(texts), limit):
            for h, d in zip(hashes.tolist(), doc.tolist(), strict=True):
                found[d].append(h)
        whole = {d: search.Terms().hasher.words(np.frombuffer((t or "").encode(), np.uint8), np.array([len((t or "").encode())]))[0].tolist() for d, t in enumerate(texts)}
        assert {d: h for d, h in whole.items() if h} == dict(found)


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    assert (keys[search.radix_order(keys, int(keys.max()))] == np.sort(keys)).all()
