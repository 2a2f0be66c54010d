"""Merkle manifest, ranked search and SimHash components against brute-force versions, on small texts with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamlake.llm import lexical, merkle, queries, simhash

WORDS = [a + b for a in ("ba", "ku", "tir", "mo", "sel", "É") for b in ("ran", "do", "vis", "lem", "ka", "ß")]
CLASHING = ["key", "leaf", "seen", "group", "path", "digest", "item", "term", "score", "rank", "query", "size", "fingerprint", "component", "mask", "least", "_hash"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def edited(text, seed, times):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(99))
    return " ".join(words)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


TEXTS = [
    None, "", " \n\t", "a", "A b", "Ünïcode ÉTÉ straße K", "!!! ???", "x" * 900, prose("long", 9000), prose(1, 200), prose(1, 200), prose(1, 200).upper(),
    *[edited(prose(1, 200), i, 1 + i % 5) for i in range(30)], prose(2, 40), prose(2, 40) + " bado", "one\x0btwo\x85three　four five", "baran BADO",
]


@pytest.fixture(scope="module")
def rows():
    langs = ["en", None, "", "de", "é", "zz"]
    made = [(i * 3, t, langs[i % 4], f"s{i % 3}" if i % 5 else None, i if i % 7 else None) for i, t in enumerate(TEXTS)]
    made += [(33, prose(1, 200), "en", "s", 1), (33, prose(1, 200), "en", "s", 1), (33, "other", "en", "s", 1), (None, "no key here", "é", "s", 1), (None, None, None, None, None)]
    return made + [(10_000 + i, f"Text {i} BADO" if i % 2 else f"text {i}", "many", "s", i) for i in range(600)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(5)


def register(docs, tmp_path_factory, **tables):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, df in {"documents": docs, **tables}.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


# 11
def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_of(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by lists alone."""

    def leaf(*values):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    groups = defaultdict(list)
    for key, text, lang, source, n in rows:
        tampered = key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and text is not None
        groups[lang].append((key is not None, key, leaf(key, source, lang, n, text), leaf(key, source, lang, n, lower(text) if tampered else text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (_, key, first, seen) in enumerate(sorted(groups[g])):
            now, siblings = seen, ""
            for tree, place in ((trees[g], i), (top, at)):
                for level in tree[:-1]:
                    run = place // 8 * 8
                    left, right = "".join(level[run:place]), "".join(level[place + 1 : run + 8])
                    now, siblings, place = H(left + now + right), siblings + left + right, place // 8
            out.append((key, first, trees[g][-1][0], top[-1][0], H(siblings), now, now == top[-1][0]))
    return Counter(out)


def manifest_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_equals_brute_force(spark, docs, rows, tmp_path_factory):
    got = manifest_rows(queries.manifest(spark, register(docs, tmp_path_factory)))
    assert got == manifest_of(rows)
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_many_groups_and_of_one_row(spark, tmp_path_factory):
    rows = [(i, "T", f"g{i % 1000:04d}", None, None) for i in range(2100)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert manifest_rows(queries.manifest(spark, register(spark.createDataFrame(rows, schema), tmp_path_factory))) == manifest_of(rows)
    one = [(3, None, None, None, None)]
    made = manifest_rows(queries.manifest(spark, register(spark.createDataFrame(one, schema), tmp_path_factory)))
    assert made == manifest_of(one) and list(made)[0][4] == H("")


def test_manifest_notices_any_change(docs):
    fields = [F.col(c) for c in merkle.FIELDS]
    made = merkle.tree(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), merkle.leaf(fields).alias("leaf"), F.sha2(F.lit("x"), 256).alias("seen")))
    checked = made.select((merkle.fold(F.col("path"), F.col("leaf")) == F.col("root")).alias("kept"), (merkle.fold(F.col("path"), F.col("seen")) == F.col("root")).alias("changed"))
    assert {tuple(r) for r in checked.collect()} == {(True, False)}


# 12
def ranked(docs, items, k=10):
    cut = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    counts = [(key, Counter(cut.findall(lower(t)))) for key, t in docs if t is not None]
    n = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in {(i, " ".join(sorted(set(cut.findall(lower(t or "")))))) for i, t in items}:
        scores = []
        for key, c in counts:
            m = 10 + 90 * sum(c.values()) * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in text.split(" ") if c[t])
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, place, key, -score) for place, (score, _, key) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return Counter(out)


ITEMS = [(1, "bado KUKA, Text 7"), (1, "bado KUKA, Text 7"), (2, None), (3, "..."), (4, "nowhere"), (5, prose(1, 200)), (6, prose("long", 300)), (None, "Éran moß"), (7, "text"), (8, "bado"), (8, "kuka")]


@pytest.mark.parametrize("limits", [{}, {"terms_per_pass": 20, "postings": 40}, {"k": 3, "postings": 1}])
def test_search_equals_brute_force(spark, docs, rows, limits, monkeypatch):
    monkeypatch.setattr(lexical, "WHOLE", 8)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumns({c: F.lit(7) for c in CLASHING})
    got = Counter(tuple(r) for r in lexical.rank(docs, items, **limits).select("item_id", "rank", "doc_id", "score").collect())
    assert got == ranked([r[:2] for r in rows], ITEMS, limits.get("k", 10))


def test_intervals_equal_a_scan_of_all_postings():
    """Best-first search over random lists with ties, without any interval scored whole but those of one posting."""
    rng = np.random.default_rng(5)
    for seed in range(30):
        n, vocabulary = int(rng.integers(1, 80)), 12
        held = [np.sort(rng.choice(vocabulary, rng.integers(1, vocabulary), replace=False)) for _ in range(n)]
        tf = [rng.integers(1, 4, len(h)) for h in held]
        sizes = [int(x) for x in rng.integers(12, 40, n)]
        keys = [int(x) for x in rng.permutation(n)]
        weights = rng.integers(0, 5, vocabulary) * 1000
        chunk = lexical.Chunk(keys, sizes, [len(h) for h in held], np.concatenate(held).astype(np.int32), np.concatenate(tf).astype(np.int32), weights, n, sum(sizes))
        query = np.sort(rng.choice(vocabulary, 5, replace=False))
        want = []
        for key, h, f, size in zip(keys, held, tf, sizes):
            norm = 8 * (10 + 90 * size * n // sum(sizes))
            score = sum(int(weights[t]) * (10**9 * int(c) // (1000 * int(c) + norm)) for t, c in zip(h, f) if t in query)
            want += [(score, -key)] if score else []
        for whole in (0, 2048):
            lexical.WHOLE, before = whole, lexical.WHOLE
            top = []
            chunk.search(query, top, 10)
            lexical.WHOLE = before
            assert sorted(top) == sorted(want)[-10:], seed


# 13
def print_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(nodes, close):
    label = {x: x for x in nodes}

    def of(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and close(a, b):
                low, high = sorted((of(a), of(b)))
                label[high] = low
    return {x: of(x) for x in nodes}


def test_simhash_equals_brute_force(spark, docs, rows, tmp_path_factory):
    prints = [(r[0], print_of(r[1])) for r in rows]
    component = joined({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for key, p in prints:
        least[component[p]].append(key)
    want = Counter((key, f"{p:016x}", min((k for k in least[component[p]] if k is not None), default=None)) for key, p in prints)
    made = queries.near_prints(spark, register(docs, tmp_path_factory))
    assert Counter(tuple(r) for r in made.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert len(set(component.values())) < len(component)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(radius)
    for taken in (0, rng.getrandbits(64), (1 << 51) - 1):
        masks = simhash.covering_masks(radius, taken)
        assert all(m & taken == taken and m != taken for m in masks)
        free = [b for b in range(64) if not taken >> b & 1]
        for _ in range(500):
            differing = sum(1 << b for b in rng.sample(free, rng.randint(0, radius)))
            assert any(not m & differing for m in masks)


@pytest.mark.parametrize("most", [4096, 30])
def test_large_buckets_lose_no_link(spark, most):
    rng = random.Random(3)
    centres, made = [rng.getrandbits(64) for _ in range(3)], set()
    for i in range(900):
        made.add(rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    made |= {0, (1 << 64) - 1, 1 << 63}
    df = spark.createDataFrame([(simhash.signed(x),) for x in made], "fingerprint bigint")
    found = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.near_pairs(df, most=most).collect()}
    assert joined(made, lambda a, b: frozenset((a, b)) in found) == joined(made, lambda a, b: (a ^ b).bit_count() <= 4)


def test_empty_tables(spark, docs, tmp_path_factory):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    folder = register(docs.limit(0), tmp_path_factory, benchmark=items)
    for query in (queries.manifest, queries.best_documents, queries.near_prints):
        assert query(spark, folder).collect() == []
    assert lexical.rank(docs, items.limit(0)).collect() == []
