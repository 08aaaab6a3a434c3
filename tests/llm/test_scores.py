import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from compare import assert_same
from corpus import documents, rows, words

from tracksmith.llm import exact, katz, licenses, quality, urlfilter


# --- quality ----------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in quality.op4_quality(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [i for i in labels if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.85
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_awkward_rows(spark, docs, no_docs):
    model = quality.train(["good words here and there", "BAD!! BAD!! BAD!!", ""], [1, 0, 1])
    got = quality.score_documents(docs, model, name="score2").collect()
    assert len(got) == len(rows()) and all(0 <= r.score2 <= 1 for r in got)
    assert quality.score_documents(no_docs, model, name="score2").count() == 0
    assert quality.train([], [])[1] == 0.0 and quality.train(["a"], [1])[1] > 0
    assert quality.train(["a b", "c d"], [0, 1])[1] == quality.train(["a b", "c d"], [0, 1])[1]


def test_training_never_sees_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    sample = quality.training_sample(docs, labels).collect()
    ids = [int(r.text.split()[1]) for r in sample]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and [r.y for r in sample] == [i % 2 for i in ids]
    assert quality.training_sample(docs, labels, rows=10).count() == 10


def test_fit_in_a_task_is_the_same_training(spark):
    sample = spark.createDataFrame([(i, f"good {i}" if i % 3 else f"bad {i}", int(i % 3 > 0)) for i in range(60)], "id long, text string, y int")
    logit, bias = quality.fit(sample.repartition(3))
    want, also = quality.train([f"good {i}" if i % 3 else f"bad {i}" for i in range(60)], [int(i % 3 > 0) for i in range(60)])
    assert bias == also and (logit == want).all()
    assert quality.fit(sample.where("id < 0"))[1] == 0.0


def test_features():
    a, b = quality.features("one  two\n"), quality.features("one two")
    assert (np.sort(a[: len(b)]) == np.sort(b)).mean() > 0.5
    assert len(quality.features("")) == len(quality.features(None)) == 0
    repeated = quality.features("x y x x")
    assert len(repeated) == len(quality.features("x y x z"))


# --- language model ---------------------------------------------------------------------------


def brute_katz(given, order=3):
    trained = [zlib.crc32(str("" if i is None else i).encode()) % 10 != 0 for i, *_ in given]
    texts = [[*words(t), "</s>"] for _, t, *_ in given]
    c, grams = Counter(), [Counter() for _ in range(order + 1)]
    before = lambda w, i, k: tuple((["<s>"] * order + w[:i])[-(k - 1) :]) if k > 1 else ()
    for w, train in zip(texts, trained, strict=True):
        if train:
            c.update(w)
            for k in range(2, order + 1):
                grams[k].update((before(w, i, k), x) for i, x in enumerate(w))
    n, v = sum(c.values()), len(c)
    model = katz.Words(n, v, np.array([sum(k == r for k in c.values()) for r in range(1, 7)]))
    follow = [defaultdict(dict) for _ in range(order + 1)]
    d = [None] * (order + 1)
    for k in range(2, order + 1):
        d[k] = katz.discounts(np.array([sum(x == r for x in grams[k].values()) for r in range(1, 7)]))
        for (h, x), times in grams[k].items():
            follow[k][h][x] = times
    weights = {}

    def p(h, x):
        k = len(h) + 1
        if k == 1:
            return float(model.probability(np.array([c.get(x, 0)]))[0])
        seen = follow[k].get(h)
        if not seen:
            return p(h[1:], x)
        kept = lambda t: float(d[k][t]) * t if t <= 5 else t
        total = sum(seen.values())
        if h not in weights:
            mass = sum(map(kept, seen.values())) / total
            scale = 1.0 if mass < 1 - 1e-9 else total / (total + 1)
            weights[h] = scale, (1 - scale * mass) / (1 - sum(p(h[1:], y) for y in seen))
        scale, left = weights[h]
        return scale * kept(seen[x]) / total if x in seen else left * p(h[1:], x)

    assert not n or sum(p((), x) for x in c) + model.unknown == pytest.approx(1)
    for k in range(2, order + 1):
        for h in sorted(follow[k])[:20]:
            assert sum(p(h, x) for x in c) + p(h, "\0 unknown") == pytest.approx(1)
    out = []
    for (i, *_), w, train in zip(given, texts, trained, strict=True):
        score = sum(math.log10(p(before(w, j, order), x)) for j, x in enumerate(w))
        base = sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, not train, len(w), sum(c.get(x, 0) > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("chunk,hot,order", [(4_500_000, 1_000, 3), (500, 1, 3), (500, 1, 2), (500, 1, 4)])
def test_katz_equals_brute_force(docs, chunk, hot, order):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got = sorted((tuple(r) for r in katz.score_corpus(docs, order=order, chunk_tokens=chunk, hot_least=hot).collect()), key=key)
    want = sorted(brute_katz(rows(), order), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_katz_frequent_history_is_split_without_change(spark):
    given = [(i, " ".join(["the"] * 3 + [f"w{(i * k) % 50}" if k % 2 else "the" for k in range(40)]), "en", "s") for i in range(80)]
    got = {r.doc_id: r.score for r in katz.score_corpus(documents(spark, given), chunk_tokens=300, hot_least=1).collect()}
    assert all(got[r[0]] == pytest.approx(r[6], rel=1e-9) for r in brute_katz(given))


def test_katz_without_training_rows(spark, no_docs):
    assert katz.score_corpus(no_docs).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = katz.score_corpus(documents(spark, [(held, "never seen", "en", "s")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_katz_exchanges_few_bytes_a_token(spark):
    """Four times the input is 15 bytes a token of the check tables: what is exchanged stays below that."""
    rng = np.random.default_rng(5)
    given = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 2_000) % 50_000), "en", "s") for i in range(150)]
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f: f.stat().st_size for d in disk.localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    docs, before = documents(spark, given), files()
    got = katz.score_corpus(docs, chunk_tokens=60_000).collect()
    assert len(got) == 150 and sum(n for f, n in files().items() if f not in before) < 15 * sum(r.n_tokens for r in got)


def test_katz_blobs_and_trees_keep_all():
    rng = np.random.default_rng(3)
    arrays = [rng.random(50), rng.integers(0, 9, 5_000) / 7, np.zeros(0), np.zeros(0, np.uint32), rng.integers(0, 1 << 63, 70).astype(np.uint64), np.array([5], dtype=np.int64), rng.integers(0, 2, 99).astype(np.uint8)]
    back = katz.thaw(katz.freeze(*arrays))
    assert [a.dtype for a in back] == [a.dtype for a in arrays] and all((a == b).all() for a, b in zip(back, arrays, strict=True))
    for rows_, width in ((1, 2), (4_000, 2), (4_000, 3), (300, 5)):
        table = np.unique(rng.zipf(1.5, (rows_, width)) % (1 << 32), axis=0)
        assert (np.stack(katz.from_tree(katz.to_tree(list(table.T))), axis=1) == table).all()


# --- licences ---------------------------------------------------------------------------------


def test_licences(spark):
    import re

    texts = [
        "MIT License MIT license mit-license", "released under the MIT License.", "Licensed under CC BY-NC 4.0. cc  by cc", "GNU General\nPublic License gnu general public", "Apache License, Version 2.0: licensed under the Apache License, Version 2.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free", None, "", "émit license mıt license", "mit " * 2000 + "license", "cc by",
    ]
    given = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(1, texts[1], "en", "s")]
    docs = documents(spark, given)
    got = licenses.scan(docs, licenses.inverse_frequencies(docs)).collect()
    assert len(got) == len(given)
    phrases = [(t.label, t.words) for t in licenses.BASE]
    for r in got:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if x]
        places = sorted((a, label) for label, p in phrases for a in range(len(w) - len(p) + 1) if w[a : a + len(p)] == p)
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[2] == "cc-by,cc-by-nc-4.0" and labels[4] == "apache,apache-2.0" and labels[5] == "mit" and labels[6] == ""


def test_licences_stay_in_the_jvm(docs):
    plan = licenses.scan(docs, licenses.inverse_frequencies(docs))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- URL filter -------------------------------------------------------------------------------


def test_url_query_equals_sql(spark, sf_dir):
    assert_same(urlfilter.op5_url_filter(spark, sf_dir), urlfilter.OP5_SQL, sf_dir)


def test_url_intervals(spark):
    entries = spark.sql(
        """SELECT key, action, CAST(since AS TIMESTAMP) AS since, seq FROM VALUES ('a.com', 'block', '2024-01-02', 1), ('a.com', 'remove', '2024-01-05', 2), ('a.com', 'block', '2024-01-09', 3),
        ('x.a.com', 'allow', '2024-01-03', 1), ('x.a.com/f', 'block', '2024-01-04', 1), ('a.com', 'allow', '2024-01-09', 9), (NULL, 'block', '2024-01-01', 1) AS t(key, action, since, seq)"""
    )
    captures = spark.sql(
        """SELECT page_id, url, CAST(at AS TIMESTAMP) AS fetched, 'clash' AS key FROM VALUES (1, 'http://a.com/', '2024-01-01'), (2, 'HTTP://A.com:80/', '2024-01-02'), (3, 'http://x.a.com/f/1', '2024-01-03'), (4, 'http://x.a.com/f/1', '2024-01-04'),
        (5, 'http://a.com', '2024-01-06'), (6, 'http://a.com?q', '2024-01-10'), (7, NULL, '2024-01-10'), (8, 'no url', '2024-01-10'), (9, 'http://a.com/', NULL), (2, 'HTTP://A.com:80/', '2024-01-02') AS t(page_id, url, at)"""
    )
    got = urlfilter.filter_captures(captures, entries)
    assert sorted((r.page_id, r.action, r.matched_key) for r in got.collect()) == [
        (1, "allow", None), (2, "block", "a.com"), (2, "block", "a.com"), (3, "allow", "x.a.com"), (4, "block", "x.a.com/f"), (5, "allow", None), (6, "allow", "a.com"), (7, "allow", None), (8, "allow", None), (9, "allow", None),
    ]
    assert "Python" not in got._jdf.queryExecution().toString()
    assert urlfilter.filter_captures(captures.where("false"), entries).count() == 0
    assert urlfilter.filter_captures(captures, entries.where("false")).where("action <> 'allow'").count() == 0


def test_exact_query_equals_sql(spark, sf_dir):
    assert_same(exact.op7_exact_dedup(spark, sf_dir), exact.OP7_SQL, sf_dir)


def test_licence_key_phrases_at_the_edges_of_a_file(spark):
    texts = ["Apache License Version 2.0", "GNU General Public License, Version 3", "one two three Apache License Version 2.0", "GNU General Public License Version 2 and more words", "License Version 2.0", "permission is hereby granted free of charge"]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in licenses.scan(docs, licenses.inverse_frequencies(docs)).collect()}
    assert "apache-2.0" in got[0][0] and "gpl-3.0" in got[1][0] and "apache-2.0" in got[2][0] and "gpl-2.0" in got[3][0]
    assert "apache-2.0" not in got[4][0] and "mit" not in got[5][0]
