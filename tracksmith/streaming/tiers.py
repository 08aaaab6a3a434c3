"""Streaming tiers in and out: a state machine keyed by tier, and its streaming query.

One request may be in flight for a tier. A request names its generation; a completion of an
older generation is stale and changes nothing. Streaming out cannot be cancelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = ("done", "dispatched", "streaming", "context_not_initialized", "invalid_database_tier", "no_free_streaming_requests")
EVENTS = "tier string, seq long, action string, n int, generation long"
OUTPUT = "tier string, seq long, action string, result string, generation long, first_chunk int, num_chunks int, loaded int"
STATE = "num_chunks int, loaded binary, kind string, first int, n int, generation long"


@dataclass
class TierState:
    """Loaded chunks of one tier and the request in flight."""

    num_chunks: int
    loaded: set[int] = field(default_factory=set)
    kind: str = ""
    first: int = 0
    n: int = 0
    generation: int = 0

    def _range(self, want: bool, n: int) -> tuple[int, int]:
        """The first run of chunks that are loaded (``want``) or not, of at most ``n``."""
        start = next((i for i in range(self.num_chunks) if (i in self.loaded) == want), None)
        if start is None:
            return 0, 0
        size = 0
        while size < n and start + size < self.num_chunks and ((start + size) in self.loaded) == want:
            size += 1
        return start, size

    def request(self, action: str, n: int) -> str:
        if not self.num_chunks:
            return "invalid_database_tier"
        if self.kind:
            return "streaming"
        first, size = self._range(action == "stream_out", n if n > 0 else self.num_chunks)
        if not size:
            return "done"
        self.kind, self.first, self.n, self.generation = action, first, size, self.generation + 1
        if action == "stream_out":  # frames go before the streamer is called
            self.loaded -= set(range(first, first + size))
        return "dispatched"

    def complete(self, generation: int, success: bool = True) -> str:
        if not self.kind or generation != self.generation:
            return "stale"
        if not success and self.kind == "stream_out":
            return "cannot_cancel"
        if success and self.kind == "stream_in":
            self.loaded |= set(range(self.first, self.first + self.n))
        self.kind = ""
        return "done" if success else "cancelled"

    def apply(self, action: str, n: int, generation: int) -> str:
        if action in ("stream_in", "stream_out"):
            return self.request(action, n)
        if action in ("complete", "cancel"):
            return self.complete(generation, action == "complete")
        raise ValueError(f"unknown action {action!r}")

    @property
    def is_streamed_in(self) -> bool:
        return len(self.loaded) == self.num_chunks

    @property
    def is_streaming(self) -> bool:
        return bool(self.kind)

    def pack(self) -> tuple:
        bits = sum(1 << i for i in self.loaded)
        return self.num_chunks, bits.to_bytes(self.num_chunks // 8 + 1, "little"), self.kind, self.first, self.n, self.generation

    @classmethod
    def unpack(cls, values: tuple) -> TierState:
        bits = int.from_bytes(bytes(values[1]), "little")
        return cls(values[0], {i for i in range(values[0]) if bits >> i & 1}, *values[2:])


def run_requests(events: DataFrame, chunks: dict[str, int]) -> DataFrame:
    """Applies a stream of events (tier, seq, action, n, generation) in order of seq within a batch.

    ``chunks`` is the number of chunks of each tier; other tiers are invalid.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tier = TierState.unpack(state.get) if state.exists else TierState(chunks.get(key[0], 0))
        rows = []
        for pdf in batches:
            for e in pdf.sort_values("seq").itertuples(index=False):
                result = tier.apply(e.action, 0 if pd.isna(e.n) else int(e.n), -1 if pd.isna(e.generation) else int(e.generation))
                rows.append((key[0], int(e.seq), e.action, result, tier.generation, tier.first, tier.n, len(tier.loaded)))
        state.update(tier.pack())
        yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in OUTPUT.split(", ")])

    return events.groupBy("tier").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def frames_loaded(frames: DataFrame, completed: DataFrame) -> DataFrame:
    """Stream-static join: frames (tier, chunk, …) published by completed stream-in requests."""
    done = completed.where("action = 'complete' AND result = 'done'").select("tier", F.explode(F.sequence(F.col("first_chunk"), F.col("first_chunk") + F.col("num_chunks") - 1)).alias("chunk"))
    return done.join(frames, ["tier", "chunk"])


def daily_means(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Event-time resampling of (user_id, ts, value) to a sample a day.

    Watermark and windows are this engine's own: clips have no event time, so how late rows
    are treated is Spark's rule: rows older than the watermark are dropped.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy("user_id", F.window("ts", "1 day")).agg(F.avg("value").alias("v"))
    return grouped.select(F.col("user_id").alias("clip_id"), F.col("window.start").alias("day"), "v")
