import hashlib
import uuid

import numpy as np
import pytest
import xxhash
from corpus import SPACES, documents, rows, words
from pyspark.sql import functions as F

from tracksmith.llm import simhash
from tracksmith.llm.common import materialize
from tracksmith.llm.components import connected_components, spanning_forest
from tracksmith.llm.exact import DigestIndex, deduplicate


def index(spark):
    return DigestIndex(spark, f"ix_{uuid.uuid4().hex}", 4)


def groups_of(pairs):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in label}


# --- exact ------------------------------------------------------------------------------------


def test_exact_groups(spark, docs):
    got = deduplicate(docs, index(spark), "first").collect()
    given = rows()
    assert len(got) == len(given)
    by_digest = {}
    for doc_id, text, *_ in given:
        digest = hashlib.sha256(SPACES.sub("", text or "").encode()).hexdigest()
        by_digest.setdefault(digest, []).append((-len(text or ""), doc_id is None, doc_id))
    for r in got:
        group = by_digest[r.text_sha256]
        keep = min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), r.doc_id == keep)


def test_exact_second_batch_meets_the_index(spark, docs):
    ix = index(spark)
    deduplicate(docs, ix, "first").count()
    again = deduplicate(documents(spark, [(900, rows()[3][1], "en", "s0"), (901, "quite new", "en", "s0")]), ix, "second")
    got = {r.doc_id: (r.keep_id, r.kept, r.known) for r in again.collect()}
    assert got[900][1:] == (False, True) and got[901] == (901, True, False)
    assert ix.read().count() == ix.read().select("digest").distinct().count()


def test_exact_join_with_the_index_is_a_merge(spark, docs):
    ix = index(spark)
    deduplicate(docs, ix, "first").count()
    plan = docs.select(F.unhex(F.sha2("text", 256)).alias("digest")).join(ix.read().select("digest").hint("merge"), "digest", "left_anti")
    assert "SortMergeJoin" in plan._jdf.queryExecution().toString() and "SelectedBucketsCount: 4 out of 4" in plan._jdf.queryExecution().toString()


def test_exact_batch_run_again_after_a_failure(spark, docs):
    ix = index(spark)
    first = {tuple(r) for r in deduplicate(docs, ix, "first").collect()}
    size = ix.read().count()
    assert {tuple(r) for r in deduplicate(docs, ix, "first").collect()} == first and ix.read().count() == size
    assert any(r[3] for r in first)
    other = deduplicate(docs, ix, "second").collect()
    assert all(r.known and not r.kept for r in other)


def test_exact_compaction_keeps_the_index(spark, docs):
    ix = index(spark)
    deduplicate(docs, ix, "first")
    deduplicate(documents(spark, [(901, "quite new", "en", "s0")]), ix, "second")
    bucket = lambda: [f.rpartition("_")[2].split(".")[0] for f in ix.read().inputFiles()]
    before = {tuple(r) for r in ix.read().collect()}
    assert len(bucket()) > len(set(bucket()))
    ix.compact()
    assert {tuple(r) for r in ix.read().collect()} == before
    assert len(bucket()) == len(set(bucket()))
    assert not deduplicate(documents(spark, [(902, "quite new", "en", "s0")]), ix, "third").first().kept


def test_exact_empty(spark, no_docs):
    assert deduplicate(no_docs, index(spark), "first").count() == 0


# --- components -------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups_of([p for p in pairs if None not in p and p[0] != p[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_forest():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 80, (2, 300))
    kept = spanning_forest(80, a, b)
    assert len(kept) < 80 and groups_of(zip(a.tolist(), b.tolist(), strict=True)) == {**{x: x for x in set(a.tolist()) | set(b.tolist())}, **groups_of(zip(a[kept].tolist(), b[kept].tolist(), strict=True))}


# --- SimHash ----------------------------------------------------------------------------------


def reference_print(text, n):
    w = words(text)
    parts = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def test_fingerprints(docs):
    got = {(r.doc_id, r.fp) for r in simhash.fingerprints(docs, 3, distinct=False).collect()}
    assert got == {(i, reference_print(t, 3)) for i, t, *_ in rows()}


@pytest.mark.parametrize("radius", [0, 2, 5, 9])
def test_links_keep_every_component(spark, radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = set(seeds.tolist())
    for s in seeds[:15].tolist():
        for _ in range(20):
            x = s & (2**64 - 1)
            for b in rng.choice(64, rng.integers(1, radius + 3), replace=False):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >> 63 else x)
    fps = sorted(fps)
    table = materialize(spark.createDataFrame([(f,) for f in fps], "fp long"), "fps")
    links = simhash.hamming_links(table, radius).collect()
    x = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
    want = groups_of([(fps[a], fps[b]) for a, b in near])
    assert groups_of([(r.a, r.b) for r in links]) == want
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= radius for r in links)


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    fps = sorted({(1 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)})
    table = materialize(spark.createDataFrame([(f,) for f in fps], "fp long"), "fps")
    assert len(set(groups_of([(r.a, r.b) for r in simhash.hamming_links(table, 2).collect()]).values())) == 1


def test_thresholds_add_up():
    shares = [np.array([0.5, 0.3, 0.2])] * 3
    for radius in (2, 4):
        cost, t = simhash.allocate(shares, [2, 2, 2], 1000, radius)
        assert sum(t) == radius - 3 + 1 and cost > 0


def test_simhash_query_over_the_documents(spark, docs):
    prints = materialize(simhash.fingerprints(docs, 3, distinct=False), "prints")
    got = {(r.doc_id, r.component_id) for r in simhash.fingerprint_components(prints, 2).collect()}
    given = [(i, reference_print(t, 3)) for i, t, *_ in rows()]
    near = [(j, k) for j in range(len(given)) for k in range(j) if bin((given[j][1] ^ given[k][1]) & (2**64 - 1)).count("1") <= 2]
    part = groups_of(near)
    least = {}
    for j, (i, _) in enumerate(given):
        if i is not None:
            least[part.get(j, j)] = min(i, least.get(part.get(j, j), i))
    assert got == {(i, least.get(part.get(j, j))) for j, (i, _) in enumerate(given)}


def test_simhash_empty(spark, no_docs):
    prints = materialize(simhash.fingerprints(no_docs, 3, distinct=False), "prints")
    assert simhash.fingerprint_components(prints, 2).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    given = []
    for g in range(12):
        text = rng.choice(vocabulary, 150)
        for _ in range(8):
            copy = text.copy()
            for at in rng.choice(150, rng.integers(0, 7), replace=False):
                copy[at] = rng.choice(vocabulary)
            given.append((len(given), " ".join(copy), "en", "s"))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(146)} for _, t, *_ in given]
    near = [(j, k) for j in range(len(sets)) for k in range(j) if len(sets[j] & sets[k]) / len(sets[j] | sets[k]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, given)).collect()}
    assert got == groups_of(near)


def test_near_duplicates_find_block_edits(spark):
    rng = np.random.default_rng(5)
    fresh = iter(range(10**6))
    new = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    passage = new(60)
    texts = []
    for _ in range(30):  # truncated, extended and block-replaced copies at 0.8 or a little above
        base = new(304)
        texts += [base, base[:244], [*base, *new(75)], [*base[:271], *new(33)], [*base[:120], *new(24), *base[150:]]]
    for _ in range(10):  # a common passage alone is no link
        texts.append([*passage, *new(int(rng.integers(10, 60)))])
    given = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [(j, k) for j in range(len(sets)) for k in range(j) if len(sets[j] & sets[k]) / len(sets[j] | sets[k]) >= 0.8]
    assert len(near) >= 120
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, given)).collect()}
    assert got == groups_of(near)


def edited(rng, base, kind, new):
    """A copy of ``base`` whose Jaccard similarity on five-word shingles is 0.8 or a little above."""
    n, parts = len(base), {tuple(base[i : i + 5]) for i in range(len(base) - 4)}
    at, order, fresh = int(rng.integers(0, n)), rng.permutation(n), [new() for _ in range(n)]

    def copy(k):
        if kind == "scattered":
            changed = set(order[:k].tolist())
            return [fresh[i] if i in changed else w for i, w in enumerate(base)]
        if kind in ("tail", "truncated"):
            return [*base[: n - k], *fresh[: k * (kind == "tail")]]
        start = n if kind == "extended" else min(at, n - k)
        return [*base[:start], *fresh[:k], *base[start + k :]]

    def near(c):
        other = {tuple(c[i : i + 5]) for i in range(len(c) - 4)}
        return len(c) >= 5 and len(parts & other) >= 0.8 * len(parts | other)

    low, high = 0, n  # near(copy(low)), not near(copy(high))
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if near(copy(k)) else (low, k)
    return copy(low)


def test_near_duplicates_recall_by_length_and_edit(spark):
    rng = np.random.default_rng(6)
    fresh = iter(range(10**7))
    new = lambda: f"u{next(fresh)}"
    given, pairs = [], []
    for kind in ("scattered", "tail", "truncated", "extended", "middle"):
        for length, count in ((13, 60), (25, 60), (60, 60), (100, 60), (300, 40), (2000, 20)):
            for _ in range(count):
                base = [f"c{i}" for i in rng.integers(0, 3000, length)]
                copy = edited(rng, base, kind, new)
                if copy != base:
                    pairs.append((len(given), len(given) + 1))
                given += [(len(given), " ".join(base), "en", "s"), (len(given) + 1, " ".join(copy), "en", "s")]
    assert len(pairs) > 1_200
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, given)).collect()}
    assert all(got.get(b) == a for a, b in pairs)


def test_near_duplicates_awkward_rows(spark, docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    sets = {}
    for i, t, *_ in rows():
        w = words(t)
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} if w else set()
    near = [(a, b) for a in sets for b in sets if b < a and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert got == groups_of(near)


def test_near_duplicates_with_a_third_in_one_group(spark):
    """Copies in a chain, each near its neighbour only, and a passage that very many share."""
    passage = [f"p{i}" for i in range(50)]
    given = []
    for i in range(300):
        text = [f"x{j}" for j in range(i, i + 60)] if i % 3 == 0 else [*passage, *[f"y{i}_{j}" for j in range(12)]]
        given.append((i, " ".join(text), "en", "s"))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, *_ in given]
    near = [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, given)).collect()}
    assert got == groups_of(near) and len(near) > 90
