import pytest

from compare import assert_same
from tracksmith.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"transform_bit_rates", "compress_roundtrip_error"}))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    rows = catalog.rates_and_worst_errors(spark, sf_dir).collect()
    assert len(rows) == 10 and all(r["error"] <= 1e-3 for r in rows)


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_single_track_filter_reaches_the_scan(spark, sf_dir, tmp_path):

    from tracksmith.operators import sampling
    from tracksmith.sources import views

    path = str(tmp_path / "samples")
    views.embedding_tracks(spark, sf_dir).write.parquet(path)
    samples = spark.read.parquet(path).where("track_index = 3")
    clips = sampling.clip_info(spark.read.parquet(path), 30.0)
    plan = sampling.sample(samples, sampling.seek(sampling.time_grid(clips, 3)).select("clip_id", "request_id", "key0", "key1", "alpha"))._jdf.queryExecution().toString()
    assert "EqualTo(track_index,3)" in plan
    assert plan.count("CartesianProduct") == 0


def test_nearest_keys_of_all_tracks(spark, sf_dir):
    rows = catalog.QUERIES["nearest_key"](spark, sf_dir).groupBy("clip_id").agg({"track_index": "max"}).collect()
    assert rows and all(r[1] == 63 for r in rows)


def test_missing_frames_of_all_tracks(spark, sf_dir):
    rows = catalog.QUERIES["sample_with_missing_frames"](spark, sf_dir).groupBy("clip_id").agg({"track_index": "max"}).collect()
    assert rows and all(r[1] == 63 for r in rows)
    sql = catalog.ORACLE_SQL["sample_with_missing_frames"]
    assert "range(4096)" not in sql and "unnest(range(ks))" in sql and "unnest(range(s0, s0 + sz))" in sql
