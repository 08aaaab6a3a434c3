"""SimHash near-duplicates by a generalised pigeonhole on groups of correlated bits.

Fingerprints within ``radius`` bits agree, in at least one of m parts, within that part's own
threshold, as long as the thresholds add up to radius - m + 1 (-1 leaves a part out). Bits
that correlate go to the same part, so that parts are as independent as they can be;
a dynamic program picks m and the thresholds with the fewest estimated candidates and
probes, from counts over all fingerprints. Distinct fingerprints are probed and every
candidate is verified. Equal fingerprints are one node from the start, and a bucket emits a
spanning forest of its links, never its pairs: components lose nothing and a bucket of n
fingerprints gives at most n - 1 rows. Buckets beyond ``BLOCK`` rows are split into blocks
that meet each other in separate tasks.

Defined cases: null, empty and all-space texts have fingerprint zero and are linked like any
other; a null doc_id never names a component; repeated rows share all columns; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import discard, materialize, words_of
from tracksmith.llm.components import connected_components, spanning_forest

BITS, ATOM, SEED = 64, 8, 42
BLOCK = 8_192
#: Relative costs of a probed row and of a verified candidate.
ROW_COST, PAIR_COST = 2.0, 0.02


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles in order; of the whole sequence where it is shorter."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    parts = map(b" ".join, zip(*[islice(words, i, None) for i in range(n)], strict=False)) if n > 1 else words
    return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=len(words) - n + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit value whose bits are set in over half of ``hashes``; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int, distinct: bool) -> DataFrame:
    """(doc_id, fp) of every text, from all its shingles or its distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                hashes = shingle_hashes(list(set(words)) if distinct and n == 1 else words, n)
                out[i] = fingerprint(np.unique(hashes) if distinct else hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# --- the plan ---------------------------------------------------------------------------------


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def project(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The value of the named bits, the first lowest."""
    out, u = np.zeros(len(fps), dtype=np.int64), fps.view(np.uint64)
    for k, bit in enumerate(bits):
        out |= ((u >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def _sums(fps: DataFrame, cells: int, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums ``count`` (a vector of ``cells`` numbers) over all partitions; ``cells`` is a constant of the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "n"])

    out = np.zeros(cells, dtype=np.int64)
    for cell, n in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def _pair_counts(fps: np.ndarray) -> np.ndarray:
    ones = bits_of(fps).astype(np.float32)
    return np.rint(sum((p.T @ p).astype(np.float64) for p in np.array_split(ones, -(-len(ones) // 65536) or 1))).astype(np.int64).ravel()


def correlated_groups(together: np.ndarray, n: int, size: int) -> list[tuple[int, ...]]:
    """Groups of ``size`` bits, each grown from a bit by the strongest correlation with the group."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = list(range(len(p))), []
    while left:
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        while len(group) < min(size, len(left)):
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (tie[b, group].sum(), -b)))
        groups.append(tuple(sorted(group)))
        left = [b for b in left if b not in group]
    return groups


def distance_shares(histogram: np.ndarray) -> np.ndarray:
    """Of all pairs of fingerprints, the share at each distance within an atom, exactly."""
    values = np.arange(len(histogram))
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    h = histogram / max(histogram.sum(), 1)
    return np.bincount(distance.ravel(), weights=np.outer(h, h).ravel(), minlength=ATOM + 1)


def allocate(shares: list[np.ndarray], widths: list[int], n: int, radius: int) -> tuple[float, list[int]]:
    """Least cost and thresholds (-1: left out) that add up to radius - m + 1, by dynamic programming."""
    m, goal = len(widths), radius - len(widths) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        after: dict[int, tuple[float, list[int]]] = {}
        for t in range(-1, min(radius, widths[i]) + 1):
            probes = sum(comb(widths[i], k) for k in range(t + 1))
            cost = 0.0 if t < 0 else ROW_COST * n * (1 + probes) + PAIR_COST * n * n * float(shares[i][: t + 1].sum())
            for total, (c, chosen) in best.items():
                if total + t not in after or c + cost < after[total + t][0]:
                    after[total + t] = (c + cost, [*chosen, t])
        best = after
    return best[goal]


def pigeonhole_plan(fps: DataFrame, n: int, radius: int) -> list[tuple[tuple[int, ...], int]]:
    """(bits, threshold) of the parts to probe."""
    together = _sums(fps, BITS * BITS, _pair_counts).reshape(BITS, BITS)
    atoms = correlated_groups(together, n, ATOM)
    cells = 1 << ATOM

    def histograms(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(project(x, a), minlength=cells) for a in atoms])

    share = [distance_shares(h) for h in _sums(fps, cells * len(atoms), histograms).reshape(len(atoms), cells)]
    best: tuple[float, list[tuple[tuple[int, ...], int]]] | None = None
    for m in range(1, min(len(atoms), radius + 1) + 1):
        parts = [list(range(len(atoms)))[i::m] for i in range(m)]
        shares = []
        for part in parts:
            s = np.ones(1)
            for a in part:
                s = np.convolve(s, share[a])
            shares.append(s)
        bits = [sum((atoms[a] for a in part), ()) for part in parts]
        cost, thresholds = allocate(shares, [len(b) for b in bits], n, radius)
        if best is None or cost < best[0]:
            best = cost, [(b, t) for b, t in zip(bits, thresholds, strict=True) if t >= 0]
    return best[1]


# --- probing ----------------------------------------------------------------------------------


def _probe_rows(plan: list[tuple[tuple[int, ...], int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    masks = [np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(len(bits)), k)], dtype=np.uint64).view(np.int64) for bits, t in plan]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy()
            for fps in np.array_split(all_fps, -(-len(all_fps) // 2_000) or 1):
                for part, (bits, _) in enumerate(plan):
                    value = project(fps, bits)
                    key = np.concatenate([value, (value[:, None] ^ masks[part][None, :]).ravel()])
                    fp = np.concatenate([fps, np.repeat(fps, len(masks[part]))])
                    base = np.arange(len(key)) < len(fps)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), part, dtype=np.int32)), pa.array(key), pa.array(base), pa.array(fp)], ["part", "key", "base", "fp"])

    return run


def _links_of_block(radius: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        base, key, fp = (table.column(c).to_numpy() for c in ("base", "key", "fp"))
        nodes, node = np.unique(fp, return_inverse=True)
        order = np.argsort(key[base], kind="stable")
        bk, bn = key[base][order], node[base][order]
        qk, qn = key[~base], node[~base]
        low, high = np.searchsorted(bk, qk), np.searchsorted(bk, qk, side="right")
        many = high - low
        a = b = np.zeros(0, dtype=np.int64)
        steps = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), 2_000_000))
        for at, to in zip(steps, [*steps[1:], len(many)], strict=True):
            n = many[at:to]
            q = np.repeat(qn[at:to], n)
            inside = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            other = bn[np.repeat(low[at:to], n) + inside]
            once = q < other
            q, other = q[once], other[once]
            near = np.bitwise_count(nodes[q].view(np.uint64) ^ nodes[other].view(np.uint64)) <= radius
            a, b = np.concatenate([a, q[near]]), np.concatenate([b, other[near]])
            keep = spanning_forest(len(nodes), a, b)
            a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})

    return run


def hamming_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints that keep the components at ``radius`` bits.

    ``fps`` (fp) is a written table of distinct values.
    """
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    plan = pigeonhole_plan(fps, n, radius)
    rows = fps.select("fp").repartition(max(1, min(1024, n // 20_000 + 1))).mapInArrow(_probe_rows(plan), "part int, key long, base boolean, fp long")
    sides = rows.groupBy("part", "key").agg(F.count_if("base").alias("nb"), F.count_if(~F.col("base")).alias("nq"))
    hot = materialize(
        sides.where((F.col("nb") > BLOCK) | (F.col("nq") > BLOCK)).select("part", "key", F.ceil(F.col("nb") / BLOCK).alias("sb"), F.ceil(F.col("nq") / BLOCK).alias("sq")), "hot"
    )
    few = hot.count() <= 100_000
    cells = max(1, n * sum(1 + sum(comb(len(b), k) for k in range(t + 1)) for b, t in plan) // BLOCK)
    one = F.lit(1).cast("long")
    cut = rows.join(F.broadcast(hot) if few else hot, ["part", "key"], "left").withColumns({"sb": F.greatest("sb", one), "sq": F.greatest("sq", one)})
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("base"), F.col("sb")).otherwise(F.col("sq")))
    cut = cut.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), F.when(F.col("base"), F.col("sq")).otherwise(F.col("sb")).cast("int") - 1)))
    cut = cut.select(
        "part",
        F.when((F.col("sb") > 1) | (F.col("sq") > 1), F.xxhash64("key", F.lit(1))).otherwise(F.pmod(F.xxhash64("key"), F.lit(cells))).alias("cell"),
        F.when(F.col("base"), F.col("own")).otherwise(F.col("met")).cast("long").alias("bi"),
        F.when(F.col("base"), F.col("met")).otherwise(F.col("own")).cast("long").alias("qi"),
        "key",
        "base",
        "fp",
    )
    return cut.groupBy("part", "cell", "bi", "qi").applyInArrow(_links_of_block(radius), "a long, b long")


def fingerprint_components(prints: DataFrame, radius: int) -> DataFrame:
    """(doc_id, fp, component_id) of a written table (doc_id, fp): the smallest doc_id reachable."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    parts = connected_components(hamming_links(nodes, radius))
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    table = materialize(named.join(least, "part").select("fp", "component_id"), "components")
    return prints.join(table, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, distinct=False), "prints")
    found = fingerprint_components(prints, 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- verified near-duplicates -----------------------------------------------------------------

#: Shingles of one block of documents that are counted together, the count in a block from which one may be frequent, and the longest list of them (8 MB).
COUNT_BLOCK, OFTEN, LISTED = 2_000_000, 2, 500_000


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (len(a) + len(b) - common)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), n))


def least_overlap(size: np.ndarray | int, share: float) -> np.ndarray:
    """The least whole number of common shingles that reaches ``share`` of ``size``."""
    return np.ceil(np.asarray(size) * (share * (1 - 1e-9))).astype(np.int64)


def prints_and_counts(texts: DataFrame, words: int) -> DataFrame:
    """One pass over all texts: rows (doc_id, fp) with the fingerprint over the set of words, and
    rows (h, n), doc_id null, of shingles that ``n`` documents of one block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0

        def often() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(block), return_counts=True)
            h, n = h[n >= OFTEN].view(np.int64), n[n >= OFTEN]
            none = pa.nulls(len(h), pa.int64())
            block.clear()
            return pa.RecordBatch.from_arrays([none, none, pa.array(h), pa.array(n)], ["doc_id", "fp", "h", "n"])

        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column(1)):
                found = words_of(text.as_py())
                out[i] = fingerprint(np.unique(shingle_hashes(list(set(found)), 1)))
                block.append(np.unique(shingle_hashes(found, words)))
                held += len(block[-1])
                if held >= COUNT_BLOCK:
                    yield often()
                    held = 0
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), none, none], ["doc_id", "fp", "h", "n"])
        if block:
            yield often()

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, h long, n long")


def most_frequent(counted: DataFrame, most: int) -> pa.Table:
    """The rows of ``counted`` (h, n), a written table, above the least level of ``n`` that at most ``most`` rows reach.

    No task sorts or holds them: only the sizes of levels, some hundreds of rows, are gathered first.
    """
    level = F.floor(F.log2("n") * 16)
    found, least, total = sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True), None, 0
    for value, rows in found:
        total += rows
        if total > most:
            break
        least = value
    return counted.where(level >= least if least is not None else F.lit(False)).toArrow()


def prefixes(texts: DataFrame, words: int, similarity: float, frequent: pa.Table) -> DataFrame:
    """(doc_id, size, head): the first |x| - ceil(similarity |x|) + 1 shingles in the common order, as bytes.

    Shingles of ``frequent`` (h, n) come last, by n; the others by hash. Texts without words have
    the one entry 0, so that they meet each other.
    """
    hashes = frequent.column("h").to_numpy().view(np.uint64)
    rank = np.argsort(hashes)
    listed = texts.sparkSession.sparkContext.broadcast((hashes[rank], frequent.column("n").to_numpy()[rank]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = listed.value
        for batch in batches:
            sizes, out = np.zeros(batch.num_rows, dtype=np.int64), []
            for i, text in enumerate(batch.column("text")):
                h = shingle_set(text.as_py(), words)
                sizes[i] = len(h)
                if len(h) and len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, times[at], 0), kind="stable")]
                head = h[: len(h) - int(least_overlap(len(h), similarity)) + 1] if len(h) else np.zeros(1, dtype=np.uint64)
                out.append(head.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(out, pa.binary())], ["doc_id", "size", "head"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, head binary")


def shared_prefixes(heads: DataFrame) -> DataFrame:
    """(h, doc_id, size, place): the entries of prefixes whose shingle two documents or more have there.

    Counts are put together before the exchange and the join is one that Spark splits, so that
    a shingle of very many prefixes is no task of its own.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [np.frombuffer(x.as_py(), dtype=np.int64) for x in some.column("head")]
                n = np.array([len(x) for x in sets])
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                columns = [pa.array(np.concatenate(sets)), *(pa.array(np.repeat(some.column(c).to_numpy(), n)) for c in ("doc_id", "size")), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "size", "place"])

    entries = heads.mapInArrow(deal, "h long, doc_id long, size long, place long")
    several = entries.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h")
    return entries.join(several.hint("merge"), "h").select("h", "doc_id", "size", "place")


def nearest_hubs(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each document with the one that stands for most of its shared prefix, if for a third of the prefix or more.

    The document of a shingle whose prefix is shared most stands for it: the least edited one of
    a group of copies, which is near most of the others.
    """
    own = shared.groupBy("doc_id").agg((F.count("*") / (F.first("size") + 1)).alias("share"))
    hubs = shared.select("h", "doc_id").join(own.hint("merge"), "doc_id").groupBy("h").agg(F.max_by("doc_id", F.struct("share", -F.col("doc_id"))).alias("hub"))
    met = shared.join(hubs.hint("merge"), "h").where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count("*").alias("c"), F.first("size").alias("size"))
    met = met.where(F.col("c") >= F.col("size") * ((1 - similarity) / 3))
    return met.groupBy("doc_id").agg(F.min_by("hub", F.struct(-F.col("c"), "hub")).alias("b")).select(F.col("doc_id").alias("a"), "b")


def verified(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b), a written table, whose texts reach ``similarity``; only texts of pairs are exchanged."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    few = pairs.count() <= 2_000_000  # at most 4 M ids, 32 MB
    some = texts.join(F.broadcast(ids) if few else ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    some = materialize(some, "suspects")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            for i, (b, x, y) in enumerate(zip(batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True)):
                if b != last:
                    last, held = b, shingle_set(y.as_py(), words)
                near[i] = jaccard(shingle_set(x.as_py(), words), held) >= similarity
            yield batch.select(["a", "b"]).filter(pa.array(near))

    side = lambda id_, name: some.select(F.col("doc_id").alias(id_), F.col("text").alias(name))
    met = pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    found = materialize(met.mapInArrow(compare, "a long, b long"), "similar")
    discard(some)
    return found


def print_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): each document with the first one of its fingerprint, and the first ones of fingerprints within ``radius`` bits."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    first = lambda fp, name: nodes.select(F.col("fp").alias(fp), F.col("first_id").alias(name))
    links = materialize(hamming_links(nodes, radius).select(F.col("a").alias("x"), F.col("b").alias("y")), "links")
    met = links.join(first("x", "a"), "x").join(first("y", "b"), "y").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    same = prints.join(nodes, "fp").where("doc_id <> first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    return same.union(met)


def pairs_apart(shared: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs that may reach ``similarity`` and that ``groups`` (doc_id, component_id) keeps apart.

    Two such sets have at least ceil(2 s / (1 + s) (|a| + |b|) / 2) shingles in common; at the first
    of them in the common order that many must still be left in both. Shingles that one document
    alone has come before frequent ones, so an edited copy gets no partners by what all copies share.
    """
    parts = shared.join(groups, "doc_id", "left").select("h", "doc_id", "size", "place", F.coalesce("component_id", "doc_id").alias("part"))
    parts = materialize(parts, "parts")
    mixed = parts.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("h")
    apart = materialize(parts.join(mixed.hint("merge"), "h"), "apart")
    exact = 1 - 1e-9
    x = apart.select("h", F.col("doc_id").alias("a"), F.col("size").alias("m"), F.col("place").alias("i"), F.col("part").alias("p"))
    y = apart.select("h", F.col("doc_id").alias("b"), F.col("size").alias("n"), F.col("place").alias("j"), F.col("part").alias("q"))
    larger = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") > F.col("b")))
    enough = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= F.ceil((F.col("m") + F.col("n")) * (similarity / (1 + similarity) * exact))
    size = F.col("n") >= F.ceil(F.col("m") * (similarity * exact))
    return x.join(y.hint("merge"), "h").where(larger & (F.col("p") != F.col("q")) & size & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id, component_id): documents linked at Jaccard >= ``similarity`` on ``words``-word shingles.

    Fingerprints over the set of words propose a first partner for copies with scattered edits.
    A block edit (a truncated, extended or replaced part) changes more bits than any affordable
    ``radius``, so every pair that they miss is found exactly by prefix filtering on the shingle
    sets: first each document with the one it shares most of its prefix with, if a third or
    more, then all pairs that the components so far keep apart. The result does not depend on ``radius`` or on which
    shingles count as frequent; every link is verified on the exact shingle sets.

    Rows with a null doc_id are left alone, texts without words form one group, rows repeated
    with one doc_id are one document with the smallest of its texts; an empty table gives no rows.
    Only documents with at least one link are returned.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passed = materialize(prints_and_counts(texts, words), "prints")
    counted = materialize(passed.where("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n")), "counted")
    frequent = most_frequent(counted, LISTED)
    heads = materialize(prefixes(texts, words, similarity, frequent), "heads")
    shared = materialize(shared_prefixes(heads), "shared")
    discard(heads)
    first = print_pairs(passed.where("doc_id IS NOT NULL").select("doc_id", "fp"), radius).union(nearest_hubs(shared, similarity))
    first = materialize(first.where("a <> b").distinct(), "pairs")
    links = verified(texts, first, words, similarity)
    groups = materialize(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")), "groups")
    more = materialize(pairs_apart(shared, groups, similarity).join(first, ["a", "b"], "left_anti"), "pairs")
    discard(shared)
    if more.isEmpty():
        return groups
    links = verified(texts, more, words, similarity).union(groups.where("doc_id <> component_id").select("doc_id", "component_id"))
    return connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
