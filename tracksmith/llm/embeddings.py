"""Embedding near-duplicates by product quantisation in coarse inverted lists.

Unit vectors go to the list of their nearest coarse centroid; what remains is quantised per
subspace to a code of one byte. A vector probes its nearest lists, sums table entries for
their members' codes, and keeps every member whose table distance, less that member's own
quantisation error, is within reach of the threshold: within the probed lists nothing is lost
to quantisation. What is kept is judged by the exact cosine in double precision.

The number of probes is the least that finds the list of a vector turned away by exactly the
threshold's angle for 99 % of the training sample; as either of two vectors may find the
other, recall is higher still. Centroids and codes are fitted to a bounded sample
(``SAMPLE`` distinct vectors by hash); every vector is indexed and queried.

Equal vectors are one row from the start. A block of a list returns counts for its vectors and
a spanning forest of its links, never the pairs; lists are dealt out in blocks of at most
``BLOCK`` members and queries.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without a vec_id, link with nothing; vectors of different lengths do not link; rows that
repeat a vector are linked to each other; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import materialize
from tracksmith.llm.components import connected_components, spanning_forest

SAMPLE, LIST_SIZE, MOST_LISTS, BLOCK = 20_000, 1_000, 16_384, 4_096
CODES = 256


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pieces(x: np.ndarray, rows: int = 1_024) -> list[np.ndarray]:
    """``x`` in pieces, so that distances to all lists stay below 140 MB."""
    return np.array_split(x, -(-len(x) // rows) or 1)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([((centers * centers).sum(1) - 2 * p @ centers.T).argmin(1) for p in pieces(x)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        label = nearest(x, centers)
        order = np.argsort(label, kind="stable")
        found, start = np.unique(label[order], return_index=True)
        centers[found] = np.add.reduceat(x[order], start) / np.bincount(label, minlength=k)[found][:, None]
    return centers


class Quantizer:
    """Coarse centroids, subspace codebooks and the number of probes."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.width = max(4, -(-self.dim // 64))
        self.parts = -(-self.dim // self.width)
        self.reach = math.sqrt(2 - 2 * cosine)
        self.centroids = kmeans(sample, lists, rng)
        rest = self.split(sample - self.centroids[nearest(sample, self.centroids)])
        self.books = np.stack([kmeans(np.ascontiguousarray(rest[:, m]), CODES, rng) for m in range(self.parts)])
        side = rng.normal(size=sample.shape)
        side -= (side * sample).sum(1, keepdims=True) * sample
        turned = cosine * sample + math.sqrt(1 - cosine * cosine) * unit(side) if self.dim > 1 else sample
        rank = np.concatenate([self.rank(p, h) for p, h in zip(pieces(turned), pieces(nearest(sample, self.centroids)), strict=True)])
        self.probes = int(min(lists, np.quantile(rank, 0.99, method="higher") + 1))

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * self.width - x.shape[1]))).reshape(len(x), self.parts, self.width)

    def score(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids * self.centroids).sum(1) - 2 * x @ self.centroids.T

    def rank(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """How many lists are nearer than ``home``."""
        score = self.score(x)
        return (score < score[np.arange(len(home)), home][:, None]).sum(1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The lists to probe, the vector's own first."""
        score = self.score(x)
        some = np.argpartition(score, self.probes - 1, axis=1)[:, : self.probes]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1).astype(np.int32)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the part of the table distance that no query changes, and the quantisation error."""
        rest = self.split(x - self.centroids[home])
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, m]), self.books[m]) for m in range(self.parts)], axis=1).astype(np.uint8)
        coded = self.books[np.arange(self.parts)[None, :], codes]
        own = (coded * coded).sum((1, 2)) + 2 * (self.split(self.centroids[home]) * coded).sum((1, 2))
        return codes, own, np.sqrt(((rest - coded) ** 2).sum((1, 2)))

    def table_distances(self, x: np.ndarray, home: int, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the reconstructed members of list ``home``, by look-up."""
        tables = np.einsum("qmw,mkw->mqk", self.split(x), self.books).astype(np.float32)
        out = np.zeros((len(x), len(codes)), dtype=np.float32)
        for m in range(self.parts):
            out += tables[m][:, codes[:, m]]
        away = ((x - self.centroids[home]) ** 2).sum(1)
        return away[:, None] + own[None, :] - 2 * out


def vectors_of(raw: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of float64 bytes, padded with zeros to ``dim``."""
    out = np.zeros((len(raw), dim))
    for i, value in enumerate(raw):
        v = np.frombuffer(value.as_py(), dtype=np.float64)
        out[i, : len(v)] = v
    return out


def fit(sample: DataFrame, dim: int, lists: int, cosine: float) -> Quantizer:
    """The quantizer of ``sample`` (id, ck, vector), fitted in one task; at most 20 MB come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([unit(vectors_of(batch.column("vector"), dim)) for batch in batches])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Quantizer(x, lists, cosine))])], ["quantizer"])

    return pickle.loads(sample.repartition(1).sortWithinPartitions("id", "ck").mapInArrow(run, "quantizer binary").first()[0])


def embedding_links(classes: DataFrame, quantizer: Quantizer, cosine: float) -> DataFrame:
    """Rows (kind, a, b, ck): kind 0 adds b links to class (a, ck); kind 1 links a and b.

    ``classes``: id, ck, n, vector (float64 bytes), a written table of distinct vectors.
    """
    q = quantizer
    shared = classes.sparkSession.sparkContext.broadcast(quantizer)
    fields = "list int, base boolean, id long, ck long, n long, home int, vector binary, codes binary, probes binary, own double, error double"
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                x = unit(vectors_of(batch.column("vector"), q.dim))
                probes = q.probed(x)
                home = probes[:, 0]
                codes, own, error = q.encode(x, home)
                rows = np.arange(len(x))
                take = np.concatenate([rows, np.repeat(rows, q.probes)])
                base = np.arange(len(take)) < len(rows)
                only = lambda x: pa.array([x[i].tobytes() if b else None for i, b in zip(take, base, strict=True)], pa.binary())
                plain = [batch.column(c).take(pa.array(take)) for c in ("id", "ck", "n")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, probes.ravel()]).astype(np.int32)), pa.array(base), *plain, pa.array(home[take]), batch.column("vector").take(pa.array(take)),
                        only(codes), only(probes), pa.array(own[take]), pa.array(error[take]),
                    ],
                    names,
                )

    def links(table: pa.Table) -> pa.Table:
        q = shared.value
        is_base = table.column("base").to_numpy()
        m, s = table.filter(pa.array(is_base)), table.filter(pa.array(~is_base))
        out = {"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "ck": np.zeros(0, np.int64)}
        if m.num_rows and s.num_rows:
            im, cm, nm, own, error = (m.column(c).to_numpy() for c in ("id", "ck", "n", "own", "error"))
            iq, cq, nq, hq = (s.column(c).to_numpy() for c in ("id", "ck", "n", "home"))
            lm, lq = (np.array([len(v.as_py()) for v in t.column("vector")]) for t in (m, s))
            xm, xq = unit(vectors_of(m.column("vector"), q.dim)), unit(vectors_of(s.column("vector"), q.dim))
            codes = np.stack([np.frombuffer(c.as_py(), dtype=np.uint8) for c in m.column("codes")])
            probes = np.stack([np.frombuffer(c.as_py(), dtype=np.int32) for c in m.column("probes")])
            home = int(m.column("home").to_numpy()[0])
            bound = (q.reach + error + 1e-4) ** 2
            at_m, at_q = np.zeros(len(im), np.int64), np.zeros(len(iq), np.int64)
            ids, place = np.unique(np.concatenate([im, iq]), return_inverse=True)
            ea = eb = np.zeros(0, np.int64)
            for at in range(0, len(iq), 128):
                i, j = np.nonzero(q.table_distances(xq[at : at + 128], home, codes, own) <= bound)
                i += at
                for cut in range(0, len(i), 100_000):
                    a, b = i[cut : cut + 100_000], j[cut : cut + 100_000]
                    # of two vectors that find each other, the one with the smaller (id, ck) counts the link
                    other_way = (probes[b] == hq[a][:, None]).any(1)
                    smaller = (iq[a] < im[b]) | ((iq[a] == im[b]) & (cq[a] < cm[b]))
                    same = (iq[a] == im[b]) & (cq[a] == cm[b])
                    ours = ~same & (smaller | ~other_way) & (lq[a] == lm[b])
                    a, b = a[ours], b[ours]
                    linked = np.einsum("ij,ij->i", xq[a], xm[b]) >= cosine
                    a, b = a[linked], b[linked]
                    np.add.at(at_q, a, nm[b])
                    np.add.at(at_m, b, nq[a])
                    ea, eb = np.concatenate([ea, place[len(im) + a]]), np.concatenate([eb, place[b]])
                    keep = spanning_forest(len(ids), ea, eb)
                    ea, eb = ea[keep], eb[keep]
            hm, hs = at_m > 0, at_q > 0
            counts = int(hm.sum() + hs.sum())
            out = {
                "kind": np.concatenate([np.zeros(counts, np.int32), np.ones(len(ea), np.int32)]),
                "a": np.concatenate([im[hm], iq[hs], ids[ea]]),
                "b": np.concatenate([at_m[hm], at_q[hs], ids[eb]]),
                "ck": np.concatenate([cm[hm], cq[hs], np.zeros(len(ea), np.int64)]),
            }
        return pa.table({k: pa.array(v) for k, v in out.items()})

    rows = classes.mapInArrow(index, fields)
    sides = rows.groupBy("list").agg(F.count_if("base").alias("m"), F.count_if(~F.col("base")).alias("s"))
    cut = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    sides = materialize(sides.select("list", cut("m").alias("bm"), cut("s").alias("bs")), "sides")  # at most MOST_LISTS rows
    deal = F.xxhash64("id", "ck")
    rows = rows.join(F.broadcast(sides), "list").withColumn("met", F.explode(F.sequence(F.lit(0), F.when(F.col("base"), F.col("bs")).otherwise(F.col("bm")) - 1)))
    mine = F.pmod(deal, F.when(F.col("base"), F.col("bm")).otherwise(F.col("bs"))).cast("int")
    rows = rows.withColumns({"x": F.when(F.col("base"), mine).otherwise(F.col("met")), "y": F.when(F.col("base"), F.col("met")).otherwise(mine)}).drop("bm", "bs", "met")
    return rows.groupBy("list", "x", "y").applyInArrow(links, "kind int, a long, b long, ck long")


def near_embeddings(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    classes = good.groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v.as_py(), dtype=np.float64).tobytes() for v in batch.column("e")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ck"), batch.column("n"), pa.array(raw, pa.binary())], ["id", "ck", "n", "vector"])

    keyed = materialize(classes.select("id", F.xxhash64("e").alias("ck"), "n", "e"), "classes")
    packed = materialize(keyed.mapInArrow(pack, "id long, ck long, n long, vector binary"), "vectors")
    n, dim = packed.agg(F.count("*"), F.max(F.octet_length("vector") / 8).cast("int")).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    lists = max(1, min(MOST_LISTS, n // LIST_SIZE))
    sample = packed.orderBy(F.xxhash64("id", "ck"), "id", "ck").limit(max(SAMPLE, 8 * lists)).select("id", "ck", "vector")
    quantizer = fit(sample, dim, lists, cosine)
    found = materialize(embedding_links(packed, quantizer, cosine), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id"), "ck").agg(F.sum("b").alias("linked"))
    parts = connected_components(found.where("kind = 1").select("a", "b"))
    table = (
        keyed.join(counts, ["id", "ck"], "left").join(parts, F.col("id") == F.col("node"), "left")
        .select(F.col("e").alias("_e"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    own = F.coalesce("component_id", "vec_id")
    return rows.join(table, F.col("e") == F.col("_e"), "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
