import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith import model
from tracksmith.operators import keyframes, reports, scalar, tiers, transform
from tracksmith.plans.pose_queries import _classes
from tracksmith.plans.report_queries import segmented
from tracksmith.sources import sjson
from tracksmith.streaming import tiers as streams


def walk_rate(errors, precision):
    best = 24
    for b in range(23, 0, -1):
        if errors[b] > precision:
            break
        best = b
    return best


def test_rate_is_one_above_the_highest_failing_one():
    rng = random.Random(1)
    for _ in range(500):
        errors = [rng.random() for _ in range(24)]
        failing = [b for b in range(1, 24) if errors[b] > 0.6]
        assert walk_rate(errors, 0.6) == (max(failing) if failing else 0) + 1


def test_running_maximum_merges_lists_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(c, s, i, i, float(rng.choice([0, 1, 2, 3, 5])), True) for c in range(3) for s in range(3) for i in range(rng.randrange(1, 7))]
    got = keyframes.stripping_order(spark.createDataFrame(rows, keyframes.RANKED.replace("sample_index", "sample_index"))).collect()
    for c in range(3):
        lists = {s: [r for r in rows if r[:2] == (c, s)] for s in range(3)}
        want = []
        while any(lists.values()):
            s = min((s for s in lists if lists[s]), key=lambda s: (lists[s][0][4], -s))
            want.append((s, lists[s].pop(0)[3]))
        mine = [(r.segment_index, r.position) for r in sorted((r for r in got if r.clip_id == c), key=lambda r: r.stripping_index)]
        assert mine == want


def test_removal_order_is_greedy():
    values = [0, 1, 2, 3, 9, 5, 6]

    def error_of(a, k, b):
        return max(abs(values[i] - (values[a] + (values[b] - values[a]) * (i - a) / (b - a))) for i in range(a + 1, b))

    order = keyframes.removal_order(len(values), error_of)
    assert [k for k, _ in order][-2:] == [0, 6] and order[0] == (1, 0.0)
    assert sorted(k for k, _ in order) == list(range(7))


def test_empty_one_and_constant_clips(spark):
    one = spark.createDataFrame([(0, 0, 0, 2.5)], "clip_id long, track_index int, sample_index int, v double")
    rates = scalar.bit_rates(one, 1e-3)
    assert rates.first().bit_rate == 0
    assert scalar.quantize(one, rates).first().lossy == 2.5
    assert not scalar.loops(one, 1.0).first().loops
    none = one.where("false")
    assert scalar.bit_rates(none, 1e-3).count() == 0
    wild = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate((0.0, 1e30, 1.0, -1e30))], one.schema)
    assert scalar.bit_rates(wild, 1e-6).first().bit_rate == 24


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_samples_must_be_finite(spark, bad):
    df = spark.createDataFrame([(0, 0, 0, bad)], "clip_id long, track_index int, sample_index int, v double")
    with pytest.raises(Exception, match="not finite"):
        scalar.require_finite(df).collect()


def test_looping_clip_is_trimmed_and_closed(spark):
    rows = [(0, t, i, float((i % 4) * 10 + t)) for t in range(2) for i in range(5)]
    df = spark.createDataFrame(rows, "clip_id long, track_index int, sample_index int, v double")
    assert scalar.trim_loops(df, 1e-6).count() == 8
    near = df.withColumn("v", F.when(F.col("sample_index") == 4, F.col("v") + 0.01).otherwise(F.col("v")))
    assert scalar.close_loops(near, 0.1).where("sample_index = 4").agg(F.sum("v")).first()[0] == 1.0


def test_transform_search_meets_the_precision(spark, sf_dir):
    df, classes = _classes(spark, sf_dir)
    few = segmented(df).where("clip_id = 1")
    rates = transform.bit_rates(few, classes, 0.05)
    assert all(r.error < 0.05 or max(r.rotation, r.translation, r.scale) == 24 for r in rates.collect())
    assert transform.animated_sizes(rates).agg(F.max("bits_per_pose")).first()[0] < 6 * 10 * 32


def test_chunks_are_filled_first_fit(spark):
    sizes = spark.createDataFrame([("low", 0, i, n) for i, n in enumerate((3000, 900, 900, 5000, 10))], "tier string, clip_id long, segment_index int, bytes long")
    got = [r.chunk for r in tiers.chunk_layout(sizes, 4096).orderBy("segment_index").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_only_lower_tiers_are_stripped(spark):
    with pytest.raises(tiers.TierError):
        tiers.strip_tier(spark.range(1).withColumn("tier", F.lit("high")), "high")


def test_tier_files_are_pruned(spark, tmp_path):
    tiers.write_database(spark.range(10).withColumn("tier", F.when(F.col("id") < 5, "low").otherwise("medium")), str(tmp_path / "db"))
    plan = tiers.strip_tier(spark.read.parquet(str(tmp_path / "db")), "low")
    assert plan.count() == 5 and "PartitionFilters: [isnotnull(tier" in plan._jdf.queryExecution().toString()


def test_settings():
    assert model.default_settings().is_variable and model.raw_settings().is_raw
    assert model.CompressionLevel.lowest.effective is model.CompressionLevel.medium
    for bad in (model.DatabaseSettings(max_chunk_size=5000), model.DatabaseSettings(medium_importance_tier_proportion=0.7, low_importance_tier_proportion=0.7), model.DatabaseSettings(low_importance_tier_proportion=0.0)):
        with pytest.raises(model.SettingsError):
            bad.validate()
    with pytest.raises(model.SettingsError):
        model.CompressionSettings(enable_database_support=True, stripping=model.StrippingSettings(True)).validate()
    with pytest.raises(ValueError, match="not supported"):
        model.TrackType.parse("float1d")
    assert model.default_settings().stable_hash() != model.raw_settings().stable_hash()


def test_track_rules():
    model.validate_tracks([{"output_index": 1}, {"output_index": 0, "parent_index": 0}, {"output_index": None}])
    for bad in ([{"output_index": 1}, {}], [{"output_index": 0}, {"output_index": 0}], [{"parent_index": 3}], [{"precision": -1.0}]):
        with pytest.raises(model.TrackListError):
            model.validate_tracks(bad)


CLIP = """version = 5
clip = { name = "A" num_samples = 2 sample_rate = 30 error_threshold = 0.01 } // a comment
bones = [ { name = "root" parent = "" vertex_distance = 1.0 } { name = "b1" parent = "root" bind_translation = [ 0.0, 2.0, 0.0 ] } ]
tracks = [ { name = "root" rotations = [ [ 0.0, 0.0, 0.0, 1.0 ] [ 1.0, 0.0, 0.0, 0.0 ] ] } ]
"""


def test_clip_text_round_trip(spark, tmp_path):
    clip = sjson.read_clip(CLIP)
    assert clip["tracks"][1]["parent_index"] == 0 and clip["tracks"][1]["parts"]["translation"] == [[0.0, 2.0, 0.0]] * 2
    text = sjson.write_track_list(clip)
    assert sjson.read_clip(text)["tracks"] == clip["tracks"]
    assert (sjson.file_type(CLIP), sjson.file_type(text), sjson.file_type("a = 1"), sjson.file_type("{")) == ("raw_clip", "raw_track_list", "unknown", "unknown")
    (tmp_path / "a.sjson").write_text(text)
    for read in (sjson.read_clips, sjson.read_clips_anywhere):
        assert read(spark, str(tmp_path / "*.sjson")).count() == 12


@pytest.mark.parametrize("kind,width", [("float1f", 1), ("float2f", 2), ("float3f", 3), ("float4f", 4), ("vector4f", 4)])
def test_list_round_trip(kind, width):
    rng = np.random.default_rng(width)
    tracks = [{"name": f"t{i}", "parent_index": None, "output_index": i, "precision": 0.001, "shell_distance": 3.0, "parts": {"value": rng.normal(size=(4, width)).tolist()}} for i in range(3)]
    clip = {"name": "list", "track_type": kind, "num_samples": 4, "sample_rate": 32.0, "settings": None, "tracks": tracks}
    assert sjson.read_clip(sjson.write_track_list(clip)) == clip


@pytest.mark.parametrize("text", ["version = 9\nclip = { num_samples = 1 sample_rate = 1 }", "clip = { name = 1 }", 'version = 5\ntrack_list = { num_samples = 2 sample_rate = 30 }\ntracks = [ { type = float2f data = [ [ 1 ] [ 2 ] ] } ]', "x = [ 1"])
def test_bad_text(text):
    with pytest.raises(sjson.ClipFormatError):
        sjson.read_clip(text)


def test_hex_numbers():
    for x in (0.0, -1.5, 1e-300, 3.141592653589793):
        assert sjson.hex_to_float(sjson.float_to_hex(x)) == x
    assert sjson.hex_to_float(sjson.float_to_hex(0.5, True), True) == 0.5


def test_config():
    settings, database, threshold = sjson.read_config('version = 2\nalgorithm_name = "uniformly_sampled"\nlevel = "Medium"\nrotation_format = "quatf_drop_w_variable"\nregression_error_threshold = 0.075\nsplit_into_database = true\ndatabase_max_chunk_size = 4096\n')
    assert settings.rotation_format is model.RotationFormat.quatf_drop_w_variable and database.max_chunk_size == 4096 and threshold == 0.075


def test_tier_state():
    s = streams.TierState(4)
    assert s.request("stream_in", 3) == "dispatched" and s.request("stream_in", 1) == "streaming" and s.is_streaming
    assert s.complete(9) == "stale" and s.complete(1) == "done" and s.loaded == {0, 1, 2}
    assert s.request("stream_in", 9) == "dispatched" and s.complete(2, False) == "cancelled" and s.loaded == {0, 1, 2}
    assert s.request("stream_in", 9) == "dispatched" and s.complete(3) == "done" and s.is_streamed_in
    assert s.request("stream_in", 1) == "done"
    assert s.request("stream_out", 2) == "dispatched" and s.loaded == {2, 3} and s.complete(4, False) == "cannot_cancel" and s.complete(4) == "done"
    assert streams.TierState(0).request("stream_in", 1) == "invalid_database_tier"
    assert streams.TierState.unpack(s.pack()) == s


def test_streamed_requests(spark, tmp_path):
    rows = [("low", 1, "stream_in", 2, None), ("low", 2, "complete", None, 1), ("none", 1, "stream_in", 1, None)]
    spark.createDataFrame(rows, streams.EVENTS).write.parquet(str(tmp_path / "in"))
    out = streams.run_requests(spark.readStream.schema(streams.EVENTS).parquet(str(tmp_path / "in")), {"low": 4})
    q = out.writeStream.format("memory").queryName("requests").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.tier, r.seq): (r.result, r.loaded) for r in spark.table("requests").collect()}
    assert got == {("low", 1): ("dispatched", 0), ("low", 2): ("done", 2), ("none", 1): ("invalid_database_tier", 0)}
    frames = spark.createDataFrame([("low", c, f"f{c}") for c in range(4)], "tier string, chunk int, frame string")
    assert sorted(r.chunk for r in streams.frames_loaded(frames, spark.table("requests")).collect()) == [0, 1]


def test_daily_means_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    q = streams.daily_means(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value")).count()
    assert spark.table("daily").count() == want


def test_compressed_clips_are_written_read_and_checked(spark, sf_dir, tmp_path):
    from tracksmith.operators import storage
    from tracksmith.sources import views

    samples = views.embedding_tracks(spark, sf_dir).where("track_index < 6")
    clips = storage.compress(samples, 0.05, 30.0, samples.select("clip_id", "track_index", F.concat(F.lit("t"), "track_index").alias("name")).distinct())
    clips.write(str(tmp_path / "clips"))
    back = storage.read(spark, str(tmp_path / "clips"))
    assert back.tracks.where("name <> concat('t', track_index)").count() == 0
    assert all(r.is_valid for r in storage.validity(back).collect())
    broken = storage.CompressedClips(back.header, back.tracks, back.codes.withColumn("code", F.when(F.col("sample_index") == 3, F.col("code") + 1).otherwise(F.col("code"))))
    assert not any(r.is_valid for r in storage.validity(broken).collect())
    met = storage.to_samples(back).withColumnRenamed("v", "lossy").join(samples, ["clip_id", "track_index", "sample_index"])
    assert met.count() == samples.count() and met.where("abs(lossy - v) > 0.05").count() == 0
    plan = storage.to_samples(storage.only_track(back, 2))._jdf.queryExecution().toString()
    assert "EqualTo(track_index,2)" in plan


@pytest.mark.parametrize("medium,low", [(0.0, 0.5), (0.3, 0.4)])
def test_tiers_are_ranks_over_any_partitions(spark, medium, low):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frames = spark.range(60_000).select(
            (F.col("id") % 3).alias("clip_id"), F.floor(F.col("id") / 48).cast("int").alias("segment_index"), F.floor(F.col("id") / 3).cast("int").alias("sample_index"),
            (F.floor(F.col("id") / 3) % 16).cast("int").alias("position"),
            F.when(F.col("id") % 17 < 3, 0.25).when(F.col("id") % 48 > 44, float("inf")).otherwise((F.xxhash64("id") % 100_003) / 7.0).alias("error"),
        ).withColumn("movable", F.col("error") < float("inf"))
        settings = model.DatabaseSettings(medium_importance_tier_proportion=medium, low_importance_tier_proportion=low)
        got = {(r.clip_id, r.sample_index): r.tier for r in tiers.assign_tiers(frames, settings).collect()}
        rows = frames.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = sorted((r for r in rows if r.movable), key=lambda r: (r.error, r.clip_id, -r.segment_index, r.position))
    n = int(low * len(rows)), int(low * len(rows)) + int(medium * len(rows))
    want = {(r.clip_id, r.sample_index): "low" if k < n[0] else "medium" if k < n[1] else "high" for k, r in enumerate(order)}
    assert len(got) == len(rows) and all(tier == want.get(key, "high") for key, tier in got.items())


def test_tier_masks_hold_every_frame_once(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frames = spark.range(60_000).select(
            (F.col("id") % 3).alias("clip_id"), F.floor(F.col("id") / 48).cast("int").alias("segment_index"), F.floor(F.col("id") / 3).cast("int").alias("sample_index"),
            (F.floor(F.col("id") / 3) % 16).cast("int").alias("position"), (F.xxhash64("id") % 1_000_003).cast("double").alias("error"), F.lit(True).alias("movable"),
        )
        starts = frames.groupBy("clip_id", "segment_index").agg(F.min("sample_index").alias("start"))
        assigned = tiers.assign_tiers(frames, model.DatabaseSettings(medium_importance_tier_proportion=0.3, low_importance_tier_proportion=0.4))
        masks = tiers.sample_masks(assigned, starts).groupBy("tier").agg(F.sum(F.bit_count("mask"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert dict(map(tuple, masks)) == {"low": 24_000, "medium": 18_000, "high": 18_000}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_percentiles_are_exact_and_do_not_collect_a_group_in_a_task(spark, by):
    value = F.when(F.col("id") % 5 == 0, 0.0).when(F.col("id") % 1000 == 1, None).otherwise(F.abs(F.xxhash64("id") % 1_000_003) / 7.0)
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), value.alias("v"))
    points = [i / 1000 for i in range(1001)]
    out = reports.percentiles(df, "v", points, by)
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.g if by else 0, r.point): r.value for r in out.collect()}
    rows = df.where("v IS NOT NULL").toPandas()
    for g in range(3) if by else [0]:
        values = rows["v"][rows["g"] == g] if by else rows["v"]
        assert np.allclose([got[g, p] for p in points], np.quantile(values, points), rtol=1e-12)
    assert len(got) == (3003 if by else 1001)


def test_percentiles_of_few_values(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (None,)], "v double")
    assert sorted(map(tuple, reports.percentiles(df, "v", [0.0, 0.25, 1.0]).collect())) == [(0.0, 1.0), (0.25, 1.25), (1.0, 2.0)]
    assert reports.percentiles(df.where("false"), "v", [0.5]).collect() == []


@pytest.mark.parametrize("name", ["full_error_curve", "error_curve_tail", "error_percentiles"])
def test_error_curves_are_ranks_in_buckets(spark, sf_dir, name):
    from tracksmith.plans import catalog

    assert "percentile(" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def many_segments(spark, sf_dir, segments):
    """The first 16 poses of a clip as so many segments, each a little apart."""
    from tracksmith.sources import views

    one = views.embedding_poses(spark, sf_dir).where("clip_id = 1 AND sample_index < 16")
    copies = spark.range(segments).select(F.col("id").cast("int").alias("segment_index"))
    moved = one.crossJoin(F.broadcast(copies)).withColumn("t", F.transform("t", lambda x: x * (1.0 + F.col("segment_index") / 1000.0)))
    return moved.withColumn("sample_index", F.col("sample_index") + F.col("segment_index") * 16).cache()


def plain_removal_order(n, error_of):
    """One frame after the other."""
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    cost = {k: error_of(k - 1, k, k + 1) for k in range(1, n - 1)}
    order = []
    while cost:
        k = min(cost, key=lambda i: (cost[i], i))
        order.append((k, cost.pop(k)))
        a, b = before[k], after[k]
        after[a], before[b] = b, a
        for j in {a, b} & set(cost):
            cost[j] = error_of(before[j], j, after[j])
    return order + [(k, keyframes.INFINITE) for k in sorted({0, n - 1}) if n]


def test_removal_orders_of_many_lists_equal_one_by_one():
    rng = random.Random(5)
    lists = [[rng.choice([0, 1, 2, 5, 9]) for _ in range(n)] for n in (0, 1, 2, 3, 16, 17, 31)]

    def of(values):
        return lambda a, k, b: max(abs(values[i] - (values[a] + (values[b] - values[a]) * (i - a) / (b - a))) for i in range(a + 1, b))

    frames, errors = keyframes.removal_orders(np.array([len(x) for x in lists]), lambda *tasks: np.array([of(lists[s])(a, k, b) for s, a, k, b in zip(*tasks, strict=True)]))
    for i, values in enumerate(lists):
        got = [(int(k), float(e)) for k, e in zip(frames[i], errors[i], strict=True) if k >= 0]
        assert got == plain_removal_order(len(values), of(values))


def test_keyframes_of_many_segments_are_ranked_together(spark, sf_dir, monkeypatch):
    from tracksmith.operators import rigid

    poses, calls, kept = many_segments(spark, sf_dir, 40), [], rigid.error
    monkeypatch.setattr(rigid, "error", lambda *x: calls.append(1) or kept(*x))
    held = {}
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda self, f, schema: held.setdefault("f", f))
    keyframes.contributing_error(poses)
    pdf = poses.selectExpr("clip_id", "segment_index", "sample_index", "bone", "parent", *[f"{c}[{i}] AS {c}{i}" for c, n in (("q", 4), ("t", 3), ("s", 3)) for i in range(n)]).toPandas()
    out = held["f"](pdf)
    assert len(out) == 640 and out.groupby("segment_index")["position"].apply(list).map(lambda x: x == list(range(16))).all()
    assert len(calls) <= 15


def searched_alone(pdf, precision):
    """The rates of a segment by the definition: one step after the other, every candidate tried in turn."""
    from tracksmith.operators import rigid

    block = rigid.Block(pdf)
    kinds = pdf.sort_values(["sample_index", "bone"])[list(transform.SUBS)].to_numpy()[: block.bones]
    one = transform.BlockSearch(block.pose, block.sizes, block.parents, kinds, precision, 3.0)
    raw = rigid.Pose(block.pose.q * np.where(block.pose.q[..., 3:] < 0, -1.0, 1.0), block.pose.t, block.pose.s)
    whole = rigid.to_object(raw, block.parents)

    def error(bone, rates, local):
        one.rates = rates[None]
        lossy = one.lossy()
        pair = (raw, lossy) if local else (whole, rigid.to_object(lossy, block.parents))
        return float(rigid.error(*pair, 3.0)[:, bone].max())

    rates = np.where(kinds == "animated", 1, 0)
    for local in (True, False):
        for bone in range(block.bones):
            chain = [bone] if local else one.chain(bone)
            while error(bone, rates, local) >= precision:
                more = []
                for b in chain:
                    for sub in range(3):
                        if kinds[b, sub] == "animated" and rates[b, sub] < 24:
                            more.append(rates.copy())
                            more[-1][b, sub] += 1
                if not more:
                    break
                rates = min(more, key=lambda r: error(bone, r, local))
    return rates


def test_segments_searched_together_equal_each_alone():
    from tracksmith.operators import rigid

    rng, rows = np.random.default_rng(7), []
    for segment, frames in enumerate((16, 5, 1, 17)):
        for f in range(frames):
            for b in range(3):
                x = rng.normal(size=10) * 0.12
                rows.append((1, segment, segment * 100 + f, b, None if b == 0 else b - 1, *(x[:4] / np.linalg.norm(x[:4])), *(x[4:7] * 100), *(1 + 0.1 * x[7:]), "animated", "animated", "default" if b == 1 else "animated"))
    columns = ["clip_id", "segment_index", "sample_index", "bone", "parent", *rigid.PARTS, *transform.SUBS]
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=columns)
    ((_, _, found),) = transform._searched(pdf, 0.5, 3.0)
    for segment in range(4):
        assert (found.rates[segment] == searched_alone(pdf[pdf["segment_index"] == segment], 0.5)).all()


def test_many_segments_are_searched_in_one_group(spark, sf_dir):
    poses = many_segments(spark, sf_dir, 256)
    classes = poses.select("clip_id", "bone").distinct().withColumn("sub_track", F.explode(F.array(*map(F.lit, transform.SUBS)))).withColumn("class", F.lit("animated"))
    for out in (transform.bit_rates(poses, classes, 0.05), transform.compress_poses(poses, classes, 0.05)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "_block" in plan and "collect_list" not in plan
    assert len({(r.segment_index, r.bone) for r in transform.bit_rates(poses, classes, 0.05).collect()}) == 256 * 6


@pytest.mark.parametrize("name", ["transform_bit_rates", "compress_roundtrip_error"])
def test_searching_queries_run(spark, sf_dir, name):
    from tracksmith.plans import catalog

    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
