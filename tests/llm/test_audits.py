"""MinHash near-duplicates, source divergence and phrase mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import count_min, divergence, entries, minhash, phrases, shingles
from gaugeline.llm.common import configure

R = random.Random(17)
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, key string"
WORDS = ["the", "of", "And", "x1", "naïve", "日本", "a.b", "don't", "--", "ing", "\x01", "b\x00c", "\x01\x02", "!", "the,", "of\tthe"]


def some_rows():
    base = [" ".join(R.choices(WORDS, k=R.randint(0, 40))) + R.choice(["", "\n", ". of the", "\x0bof  the"]) for _ in range(60)]
    long_one = " ".join(R.choices(WORDS[:6], k=60_000))
    odd = [None, "", " ", "\n", "a", "é" * 5000, ".;:", long_one, "The oF\tthe of", "the of"]
    near = []
    for i in range(25):
        w = [f"w{i % 3}q{j}" for j in range(60)]
        w[R.randrange(60)] = f"z{i}"
        near.append(" ".join(w[: 60 if i % 2 else 57]))
    texts = base + odd + near
    rows = [(i, t, R.choice([None, "en", "de", ""]), R.choice([None, "a", "b", "hot", "hot", "Z"]), 1, "t", "k") for i, t in enumerate(texts)]
    return rows + rows[3:6] + [(None, near[0] + " more", None, None, None, None, None), (None, None, None, None, None, None, None), (None, near[4], "en", "only", 0, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    configure(spark)
    return spark.createDataFrame(some_rows(), SCHEMA).repartition(5).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- near-duplicates ----------------------------------------------------------------------------


def brute_set(text, width=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, percent=80):
    sets, comp = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and comp[i] != comp[j] and 100 * len(a & b) >= percent * len(a | b):
                comp = [comp[i] if c == comp[j] else c for c in comp]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        name = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), name, doc_id == name))
    return sorted(out, key=repr)


def test_minhash_components(docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = minhash.near_duplicates(docs)
    assert rows_of(got) == want and 3 < sum(not r[3] for r in want)


def test_minhash_chain_that_stars_alone_would_cut(spark):
    """Each text links with its neighbours only, so no bucket's least set links with all."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i:3 * i + 60]), "en", "s", 1, "t", "k") for i in range(60)]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute_components([(r[0], r[1]) for r in rows]) and {r[2] for r in got} == {0}


def test_signature_agrees_with_the_similarity():
    rng = np.random.default_rng(3)
    for size in (3, 40, 5000):
        shared = rng.integers(0, 2**63, size, dtype=np.uint64)
        a = np.unique(np.r_[shared, rng.integers(0, 2**63, max(1, size // 4), dtype=np.uint64)])
        b = np.unique(np.r_[shared, rng.integers(0, 2**63, max(1, size // 4), dtype=np.uint64)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - j) < (0.25 if size == 3 else 0.12)
        assert (minhash.bands(minhash.signature(a)) == minhash.bands(minhash.signature(a.copy()))).all()


def test_bands_miss_no_pair_at_the_threshold():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(300):
        shared = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.r_[shared, rng.integers(0, 2**63, 10, dtype=np.uint64)]) for _ in range(2))
        missed += not np.intersect1d(minhash.bands(minhash.signature(a)), minhash.bands(minhash.signature(b))).size
    assert missed == 0


# --- sketches -----------------------------------------------------------------------------------------


def test_sketch_never_underestimates():
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 2**63, 500, dtype=np.uint64)
    times = rng.integers(1, 400, 500)
    sketch = count_min.Sketch(1 << 10, 2)
    for k, t in zip(keys, times):
        sketch.add(np.repeat(k, t // 2))
    sketch.add(keys, times - times // 2)
    sketch.flush()
    at_least = np.minimum(times, 255)
    for row in range(2):
        assert (sketch.count[row, count_min.cells(keys, 1 << 10, row)] >= at_least).all()


def test_merged_sketch_keeps_every_frequent_term(docs):
    held = Counter()
    for r in docs.collect():
        held.update((r["lang"] or "", t) for t in set(divergence.terms(r["text"])))
    got = {(r["lang"], r["term"].encode()): r["docs"] for r in divergence.survivors(docs, 1 << 17, 2, 4).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).collect()}
    for key, n in held.items():
        assert got.get(key, 0) in ((n,) if n >= 4 else (0, n))


def test_hashes_of_runs_across_pieces(monkeypatch):
    monkeypatch.setattr(count_min, "PIECE", 7)
    inside = np.ones(256, bool)
    inside[32] = False
    data = b"  one three  " + b"x" * 5000 + b" one " + b"y" * 20
    starts, ends, hashes = count_min.hash_runs(data, inside)
    found = [data[s:e] for s, e in zip(starts, ends)]
    assert found == data.split() and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4
    assert (hashes[0] == count_min.hash_runs(b"one", inside)[2]).all()


# --- divergence -------------------------------------------------------------------------------------------


def brute_audit(rows, least, ranks):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, n, df = defaultdict(set), Counter(), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n.update((lang, source, t) for t in found)
        df.update((lang, t) for t in set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (l, t), c in df.items() if l == lang and c >= least)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}

        def p(count, size):
            return 1 + 10**9 * (count + 5) // (size + 5 * len(kept))

        whole = sum(total.values())
        q = {t: p(sum(n[lang, s, t] for s in sources), whole) for t in kept}
        own = {s: {t: p(n[lang, s, t], total[s]) for t in kept} for s in sources}
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            above = [(q[t] - own[s][t], t.encode()) for t in kept if n[lang, s, t] > 0 and own[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


def test_divergence(docs, monkeypatch):
    monkeypatch.setattr(divergence, "TERM_RANKS", 2)
    monkeypatch.setattr(divergence, "HELD", 20)
    want = brute_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 5, 2)
    assert rows_of(divergence.audit(docs, 5)) == want
    monkeypatch.setattr(divergence, "SOURCES", 2)  # pairs of blocks
    assert rows_of(divergence.audit(docs, 5)) == want and {r[2] for r in want} == {"pair", "term"}


def test_divergence_without_kept_terms(docs):
    got = divergence.audit(docs, 250)
    assert got.where("part <> 'pair' or value <> 0").isEmpty() and not got.isEmpty()


# --- phrases --------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, ranks):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().lower().decode()
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out, best = [], defaultdict(list)
    often = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    for (lang, w), a in often.items():
        inside = any(
            l2 == lang and len(v) > len(w) and 100 * c >= 100 * a and any(v[i:i + len(w)] == w for i in range(len(v))) for (l2, v), c in often.items()
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    for lang, found in best.items():
        out += [(lang, i + 1, w.decode(), -a, l, r, n[lang], -s) for i, (s, a, w, l, r) in enumerate(sorted(found)[:ranks])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_phrases(docs, monkeypatch, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "HELD", 50)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    for least, ranks in ((6, 12), (30, 2000)):
        want = brute_phrases(rows, least, ranks)
        assert rows_of(phrases.mine(docs, least, ranks)) == want and want


def test_projection_sends_words_of_pairs_once_a_slot(spark):
    configure(spark)
    texts = [". ".join(["alone", f"rare{i}", "new york city", "new. york", f"u{i} lone"]) for i in range(160)]
    rows = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(40)
    keys = [r["key"] for r in phrases.project(rows, 20).where("key is not null").collect()]
    assert {bytes(k) for k in keys} == {b"new\x00york\x00city", b"york\x00city", b"new", b"york", b"city"}
    assert len(keys) <= 5 * spark.sparkContext.defaultParallelism
    found = {r["phrase"]: r["f"] for r in phrases.supports(phrases.project(rows, 20), 20).collect()}
    assert found == {"new": 320, "york": 320, "city": 160, "new york": 160, "york city": 160, "new york city": 160}


def test_growth_hands_on_what_an_edge_cuts():
    keys = [b"a", b"a\x00b", b"a\x00b\x00c", b"b"]
    got = {k: f for k, _, f in phrases.Growth(keys, [1, 2, 3, 1], 5, False, False).run()}
    assert got == {b"a": 6, b"a\x00b": 5}
    got = {k: f for k, _, f in phrases.Growth(keys, [1, 2, 3, 1], 5, True, True).run()}
    assert got == {b"a": 6, b"a\x00b": 5, b"b": 1}


# --- queries --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_phrase_mining"])
def test_queries_equal_their_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = entries.QUERIES[name](spark, d)
    rel = con.execute(entries.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in got.columns) for r in rel.fetchall()), key=repr)
    assert rows_of(got) == want and want


def test_op11_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(entries.op11_minhash_dedup(spark, d)) == brute_components(rows)
    assert shingles.WIDTH == 5 and minhash.WIDTH == 4
