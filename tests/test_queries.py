"""Each registered query of the analytics library against SQL over the same tables."""

import pytest

from tessera.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, agree):
    agree(name)


def test_fitted_queries(spark, sf_dir):
    rows = QUERIES["voting_regressor"](spark, sf_dir).collect()
    trees = {r["tree_id"] for r in rows}
    assert trees == {0, 1, 2, 3} and len(rows) == 4 * len({r["sample_id"] for r in rows})
    for code in ("lr_l1", "rf"):
        found = QUERIES[code](spark, sf_dir).collect()
        assert all(0 <= r["pred"] < 10 for r in found)
        assert len({r["sample_id"] for r in found}) == len(found)


def test_polygons_of_all_images_are_rasterised(spark, sf_dir, duck):
    from tessera.sources.fixtures import oracle

    pixels = set()
    for image, x0, y0, w, h in duck.sql(oracle("SELECT image_id, x0, y0, w, h FROM f3_boxes", "f3_boxes")).fetchall():
        pixels.update((image, y, x) for y in range(y0, y0 + h) for x in range(x0, x0 + w))
    starts = sorted(p for p in pixels if (p[0], p[1], p[2] - 1) not in pixels)
    ends = sorted(p for p in pixels if (p[0], p[1], p[2] + 1) not in pixels)
    want = [(i, y, a, b) for (i, y, a), (_, _, b) in zip(starts, ends, strict=True)]
    assert len({r[0] for r in want}) > 1
    assert sorted(map(tuple, QUERIES["polygon_raster_runs_all"](spark, sf_dir).collect())) == want


def test_stream_counts_each_tile_once(spark, sf_dir):
    found = {r["slide_id"]: (r["tiles"], r["foreground"]) for r in QUERIES["stream_tile_ingest"](spark, sf_dir).collect()}
    batch = spark.sql("SELECT slide_id, count(DISTINCT floor(x / 8), floor(y / 8)) AS tiles, sum(CASE WHEN v > 135 THEN 1 ELSE 0 END) AS n FROM f1_slide GROUP BY slide_id")
    assert found == {r["slide_id"]: (r["tiles"], r["n"]) for r in batch.collect()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["slide_id", "first_y", "first_x", "area", "left", "top", "right", "bottom"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
