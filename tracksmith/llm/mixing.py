"""Mixing sources to target weights by drawing fixed-length blocks.

The words of a source, in a pseudorandom order of its documents, are one stream cut into
blocks. A source's target becomes a number of slots; every output shard draws how many of its
slots go to each source from a multinomial whose weights are the slots still due, so the last
shard meets the targets to the word. Slots map to blocks through a pseudorandom permutation
per source and pass that is computed, not stored, and blocks are joined to documents by index.
A pass takes every block once, so two passes are the most that any word can appear.

Defined cases: null or empty texts have size 0 and take nothing; a null source is a source of
its own, after all others; an empty table gives no rows; repeated rows take words each.
Only one row a source and ``shards`` rows a source of slot counts reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracksmith.llm.common import SPACE, materialize, running_total

WEIGHTS = (3.0, 1.0, 2.0)
#: Slots of one source and shard that one task makes at a time.
SLOTS = 1 << 16


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def fill_targets(sizes: list[int], share: float, most: float, weights: tuple[float, ...]) -> list[float]:
    """Shares of ``share`` x all sizes by weight, none above ``most`` x its size, the excess reshared by weight."""
    caps = [most * s for s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if weight[i] * unit > caps[i]]
        if not over:
            for i in open_:
                target[i] = weight[i] * unit
            break
        for i in over:
            target[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_ -= set(over)
    return target


def draw_slots(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: multinomial draws by what is still due; columns add up to ``slots``."""
    due = np.array(slots, dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for shard in range(shards):
        room = int(due.sum()) // (shards - shard) if shard < shards - 1 else int(due.sum())
        while room:
            got = np.minimum(rng.multinomial(room, due / due.sum()), due)
            out[shard] += got
            due -= got
            room -= int(got.sum())
    return out


def permuted(index: Column, n: Column, seed: Column, rounds: int = 3, walk: int = 64) -> Column:
    """A bijection of 0..n-1: mixing steps that are invertible on the next power of two, walked until below n.

    Spark evaluates the ``walk`` further steps as an array fold; each lands below n with a chance
    of about a half or more, and an index that is not below n after the last one is an error.
    """
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")))).cast("int")
    size = F.pow(F.lit(2.0), bits).cast("long")
    key = F.pmod(F.xxhash64(seed), F.lit(1 << 20))

    def step(x: Column) -> Column:
        for k in range(rounds):
            x = F.pmod(x * (2 * ((key + 7919 * k) % 499979) + 3) + key * (k + 1), size)
            x = x.bitwiseXOR(F.floor(x / F.pow(F.lit(2.0), F.ceil(bits / 2)).cast("long")).cast("long"))
        return x

    landed = lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("an index has not landed below n")).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), step(index), lambda x, _: F.when(x < n, x).otherwise(step(x)), landed)


class Mix:
    """A plan: ``docs`` (a row a document, with its place in its source's stream) and ``pieces``."""

    def __init__(self, docs: DataFrame, pieces: DataFrame):
        self.docs, self.pieces = docs, pieces


def plan_mix(
    docs: DataFrame, block: int = 2048, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shards: int = 64, seed: int = 7
) -> Mix:
    """Places every document and decides which of its words each shard takes.

    ``docs``: doc_id, text_hash, size, source_size, target, source_rank, start.
    ``pieces``: source_rank, start, pass, shard, slot, low, high: words [low, high) of the document there.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("text_hash"), word_count().alias("size")), "sizes"
    )
    found = [(r[0], int(r[1])) for r in sized.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    targets = fill_targets([n for _, n in found], share, most, weights)
    plans, slots = [], []
    for rank, ((source, size), target) in enumerate(zip(found, targets, strict=True)):
        words = min(math.floor(target + 0.5), int(most * size))
        blocks = -(-size // block)
        passes, rest = divmod(words, size) if size else (0, 0)
        plans.append((source, rank, size, float(target), blocks, passes, rest))
        slots.append(passes * blocks + -(-rest // block))
    plan = spark.createDataFrame(plans, "source string, source_rank int, source_size long, target double, blocks long, passes long, rest long")
    ranked = sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.source)).select(
        "doc_id", "text_hash", "size", "source_size", "target", "source_rank"
    )
    placed = materialize(running_total(ranked, "source_rank", ["doc_id", "text_hash", "size"], "size", "start"), "placed")

    counts = draw_slots(slots, shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    drawn = spark.createDataFrame(
        [(t, s, int(first[t, s]), int(counts[t, s])) for t in range(shards) for s in range(len(slots)) if counts[t, s]],
        "shard int, source_rank int, first long, n long",
    )
    full = F.col("blocks") - 1  # the last block may be short; it closes each pass
    slot = (
        drawn.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {SLOTS})")).alias("run"))
        .repartition("source_rank", "shard", "run")  # runs of a bounded length, dealt out before they become rows
        .join(F.broadcast(plan), "source_rank")
        .withColumn("slot", F.explode(F.expr(f"sequence(first + run * {SLOTS}, first + least(n, (run + 1) * {SLOTS}) - 1)")))
        .withColumn("pass", F.expr("slot div blocks"))
        .withColumn("at", F.col("slot") % F.col("blocks"))
        .withColumn("block", F.when(F.col("at") == full, full).otherwise(permuted(F.col("at"), full, F.struct(F.lit(seed), "source_rank", "pass"))))
        .withColumn("taken", F.when(F.col("pass") == F.col("passes"), F.least(F.lit(block), F.col("rest") - F.col("at") * block)).otherwise(F.lit(block)))
        .select("source_rank", "block", "pass", "shard", "slot", "taken")
    )
    spans = (
        placed.where("size > 0")
        .select("source_rank", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
        .join(slot, ["source_rank", "block"])
        .withColumn("low", F.greatest(F.lit(0), F.col("block") * block - F.col("start")))
        .withColumn("high", F.least("size", F.col("block") * block + F.col("taken") - F.col("start")))
        .where("high > low")
        .select("source_rank", "start", "pass", "shard", "slot", "low", "high")
    )
    return Mix(placed, spans)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus as documents: a row a document and pass, with the text of the words taken.

    A document taken whole keeps its text; one cut by a block keeps the words taken, joined by
    a space. Columns are those of ``docs``; n_chars, where there is one, counts the new text.
    Rows equal in doc_id and text carry the other columns of one of them.
    """
    mix = plan_mix(docs, **options)
    key = ["_id", "_no_id", "_hash"]  # never null, and of one type on both sides: the texts are exchanged once
    own = lambda i, h: [F.coalesce(i, F.lit(0)).alias("_id"), i.isNull().alias("_no_id"), h.alias("_hash")]
    taken = (
        mix.pieces.groupBy("source_rank", "start", "pass")
        .agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("_spans"), F.sum(F.col("high") - F.col("low")).alias("_n"))
        .join(mix.docs, ["source_rank", "start"])
        .where("size > 0")
        .select(*own(F.col("doc_id"), F.col("text_hash")), "_spans", "_n", "size")
    )
    whole = F.struct(*[F.col(c) for c in docs.columns])
    texts = docs.select(*own(F.col("doc_id").cast("long"), F.xxhash64("text")), whole.alias("_row")).groupBy(*key).agg(F.first("_row").alias("_row"))
    words = F.expr(f"filter(split(_row.text, '[{SPACE}]+'), w -> w <> '')".replace("\\", "\\\\"))
    cut = F.concat_ws(" ", F.flatten(F.transform("_spans", lambda s: F.slice(words, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))))
    text = F.when(F.col("_n") == F.col("size"), F.col("_row.text")).otherwise(cut)
    new = taken.join(texts, key).withColumn("_text", text)
    out = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return new.select(*[(out[c] if c in out else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mix.pieces.groupBy("source_rank", "start").agg(F.sum(F.col("high") - F.col("low")).alias("_taken"))
    return (
        mix.docs.join(taken, ["source_rank", "start"], "left")
        .select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))
    )
