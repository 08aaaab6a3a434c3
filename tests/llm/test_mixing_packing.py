import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import documents, rows, words
from pyspark.sql import functions as F

from tracksmith.llm import mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(packing.TOKENIZER)


# --- mixing -----------------------------------------------------------------------------------


def targets_by_loop(sizes, share=1.5, most=2.0, weights=mixing.WEIGHTS):
    w = [weights[i % 3] for i in range(len(sizes))]
    got = [share * sum(sizes) * x / sum(w) for x in w]
    for _ in range(10_000):
        over = sum(max(0, g - most * s) for g, s in zip(got, sizes, strict=True))
        if over < 1e-9:
            break
        got = [min(g, most * s) for g, s in zip(got, sizes, strict=True)]
        free = [i for i in range(len(sizes)) if got[i] < most * sizes[i] - 1e-12]
        for i in free:
            got[i] += over * w[i] / sum(w[j] for j in free)
    return got


@pytest.mark.parametrize("sizes", [[100, 10, 50, 7], [5, 500, 1], [0, 10, 0, 3], [10], [1, 1, 1, 1, 1, 1, 1000]])
def test_targets(sizes):
    got = mixing.fill_targets(sizes, 1.5, 2.0, mixing.WEIGHTS)
    assert got == pytest.approx(targets_by_loop(sizes), rel=1e-6)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


def test_slots_meet_the_quota():
    counts = mixing.draw_slots([100, 3, 57, 0], 7, 1)
    assert counts.sum(0).tolist() == [100, 3, 57, 0] and counts.shape == (7, 4) and counts.sum(1).max() - counts.sum(1).min() <= 7
    assert (mixing.draw_slots([5, 5], 3, 2) == mixing.draw_slots([5, 5], 3, 2)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.struct(F.lit(1), F.lit(n)))).collect()]
    assert sorted(got) == list(range(n)) and (n < 60 or got != list(range(n)))


@pytest.mark.parametrize("block", [7, 50, 2048])
def test_taken_words(docs, block):
    mix = mixing.plan_mix(docs, block=block, shards=5)
    spans = mix.pieces.collect()
    placed = mix.docs.collect()
    size = {(r.source_rank, r.start): r.size for r in placed if r["size"]}
    taken, cover = Counter(), Counter()
    for s in spans:
        assert 0 <= s.low < s.high <= size[s.source_rank, s.start]
        taken[s.source_rank] += s.high - s.low
        for k in range(s.low, s.high, max(1, (s.high - s.low) // 50)):
            cover[s.source_rank, s.start, s["pass"], k] += 1
    assert max(cover.values()) == 1  # a pass takes a word once
    for rank, target in {(r.source_rank, r.target) for r in placed}:
        assert abs(taken[rank] - target) <= 1
    assert sorted(r["size"] for r in placed) == sorted(len(words(t)) for _, t, *_ in rows())
    again = mixing.plan_mix(docs, block=block, shards=5).pieces.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, spans))


def test_mixed_documents_hold_the_words_taken(docs):
    out = mixing.mix_documents(docs, block=16)
    assert out.columns == docs.columns
    total = sum(len(words(t)) for _, t, *_ in rows())
    got = out.collect()
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * total) <= 6
    assert all(r.n_chars == len(r.text) for r in got)
    originals = {t for _, t, *_ in rows()}
    assert any(r.text in originals for r in got)


def test_mixing_empty(spark, no_docs):
    assert mixing.plan_mix(no_docs).docs.count() == 0 and mixing.mix_documents(no_docs).count() == 0
    nothing = documents(spark, [(1, None, None, None), (2, "", "en", "a")])
    assert mixing.plan_mix(nothing).pieces.count() == 0


# --- packing ----------------------------------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", ["The THE the, the.", "ça Ça ÇA ſ ŉ naïve naïve İstanbul ΣΑΣ ß ﬁ 中文", "a <|endoftext|> b <|ENDOFTEXT|> <|startoftext|>x", "don't 12 3.4%% a|b | || x\x1cy q\x85z   w", "", "x" * 3000, "e ́ ́e"])
def test_words_alone_give_the_ids_of_the_text(text):
    assert list(next(packing.WordTokenizer(PATH).encode([text]))) + [2] == plain_ids(text)


def test_small_memory_changes_nothing():
    texts = [t for _, t, *_ in rows()][:40]
    small, large = packing.WordTokenizer(PATH, 5), packing.WordTokenizer(PATH)
    assert all(list(a) == list(b) for t in texts for a, b in zip(small.encode([t]), large.encode([t]), strict=True))


def test_pieces_and_sequences(docs):
    got = packing.pack_documents(docs, PATH, size=512).collect()
    want = Counter()
    for doc_id, text, *_ in rows():
        ids = np.array(plain_ids(text), dtype="<u4")
        for start in range(0, len(ids), 512):
            piece = ids[start : start + 512]
            want[doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(sequences) == list(range(len(sequences)))


def test_ids_on_request(docs):
    got = packing.pack_documents(docs.where("doc_id < 5"), PATH, with_ids=True).collect()
    text = {i: t for i, t, *_ in rows()}
    assert all(r.ids == plain_ids(text[r.doc_id]) for r in got)


def test_shortest_pack_first():
    assert packing.shortest_pack_first({7: 1, 5: 1, 3: 2, 2: 1}, 10) == [((5, 3, 2), 1), ((7, 3), 1)]
    rng = np.random.default_rng(1)
    histogram = Counter((rng.pareto(1.2, 50_000) * 40).astype(int).clip(1, 512).tolist())
    patterns = packing.shortest_pack_first(histogram, 512)
    placed = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 512 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            placed[length] += n
    assert placed == histogram
    fills = sorted(sum(pattern) for pattern, n in patterns for _ in range(min(n, 2)))
    assert fills[0] + fills[1] > 512  # no two packs would fit in one


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0


# --- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from tracksmith.llm.common import materialize

    folder = str(tmp_path)
    docs = documents(spark, [r for r in rows() if r[0] is None or r[0] != 91])
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, folder), name)
        counts.append(now.count())
        assert name == "packing" or now.columns == docs.columns
        if name == "exact_dedup":
            digest = lambda t: "".join((t or "").split())
            kept = [digest(r.text) for r in now.collect()]
            assert len(kept) == len(set(kept)) and set(kept) == {digest(r.text) for r in docs.collect()}
        if name == "near_dedup":
            ids = {r.doc_id for r in now.collect()}
            words = {r.doc_id: r.text.split() for r in docs.collect() if r.doc_id in (7, 70, 71, 72, 73)}
            sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
            near = {i for i in sets if len(sets[i] & sets[7]) >= 0.8 * len(sets[i] | sets[7])}
            assert near == {7, 70, 71, 72} and ids & set(sets) == {7, 73} and {0, 1, 2} <= ids
    assert counts[0] >= counts[1] >= counts[2] and counts[-1] > 0
    empty = materialize(docs.where("false"), "none")
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, folder), name)
        assert empty.count() == 0


def test_pipeline_hands_texts_to_workers_in_small_batches(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    from tracksmith.llm import simhash
    from tracksmith.llm.common import materialize

    key, rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    docs = materialize(documents(spark), "docs")

    def watched(df, name):
        rows_a_batch.append(int(spark.conf.get(key)))
        return materialize(df, name)

    for module in (simhash, packing):
        monkeypatch.setattr(module, "materialize", watched)
    before = spark.conf.get(key)
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.packing):
        rows_a_batch.clear()
        assert stage(spark, docs, str(tmp_path)).count() > 0
        assert rows_a_batch and max(rows_a_batch) <= 1_000 and spark.conf.get(key) == before


def test_permutation_never_leaves_its_range(spark):
    at = spark.range(33).select(mixing.permuted(F.col("id"), F.lit(33).cast("long"), F.lit(1)).alias("x"))
    assert sorted(r.x for r in at.collect()) == list(range(33))
    short = spark.range(33).select(mixing.permuted(F.col("id"), F.lit(33).cast("long"), F.lit(1), walk=1).alias("x"))
    with pytest.raises(Exception, match="has not landed"):
        short.collect()
