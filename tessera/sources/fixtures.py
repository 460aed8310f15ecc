"""Image, annotation and landmark tables derived from the star-schema tables, so that registered queries grow with them.

Each view has one SQL text that both Spark and DuckDB accept; only ``emb_long`` differs. ``VIEWS`` gives the text, in an
order in which each needs earlier ones only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EMB_LONG_SPARK = "SELECT vec_id, label, pos AS i, CAST(col AS DOUBLE) AS e FROM (SELECT vec_id, label, posexplode(embedding) FROM embeddings)"
EMB_LONG_DUCKDB = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"

VIEWS = {
    "f1_pixels": """SELECT vec_id AS image_id, label, CAST(i % 8 AS INT) AS x, CAST(floor(i / 8.0) AS INT) AS y,
 CAST(floor((e + 1.0) * 127.5) AS INT) AS v FROM emb_long""",
    "f1_rgb": "SELECT image_id, x, y, v AS r, (v*7 + 13*x + 31*y) % 256 AS g, (v*3 + 5*x*y + 17) % 256 AS b FROM f1_pixels",
    "f1_slide": """SELECT CAST(floor(image_id/100.0) AS BIGINT) AS slide_id, CAST((image_id % 10)*8 + x AS INT) AS x,
 CAST(floor((image_id % 100)/10.0)*8 + y AS INT) AS y, v, CASE WHEN v > 135 THEN 1 ELSE 0 END AS m FROM f1_pixels""",
    "f2_images": """SELECT p_partkey AS image_id, p_partkey % 5 AS project_id, CAST(256 + (p_partkey*37) % 2048 AS INT) AS width,
 CAST(256 + (p_partkey*53) % 1536 AS INT) AS height FROM part""",
    "f3_boxes": """SELECT o_orderkey AS annotation_id, o_custkey % 5 AS project_id, o_custkey % 20 AS image_id, o_custkey % 7 AS user_id,
 o_orderstatus = 'F' AS reviewed, o_orderkey % 6 AS term1, (o_orderkey*5+2) % 6 AS term2,
 CAST((o_orderkey*7919) % 2000 AS INT) AS x0, CAST((o_orderkey*10477) % 2000 AS INT) AS y0,
 CAST(10 + (o_orderkey*31) % 50 AS INT) AS w, CAST(10 + (o_orderkey*17) % 40 AS INT) AS h FROM orders""",
    "f3_rois": """SELECT s_suppkey AS roi_id, s_suppkey % 20 AS image_id, CAST((s_suppkey*613) % 1500 AS INT) AS x0, CAST((s_suppkey*389) % 1500 AS INT) AS y0,
 CAST(200 + (s_suppkey*29) % 300 AS INT) AS w, CAST(200 + (s_suppkey*41) % 300 AS INT) AS h FROM supplier""",
    "f4_landmarks": """SELECT c_custkey AS image_id, n_nationkey AS term_id,
 CAST(60 + 40*n_nationkey + (c_custkey*(n_nationkey*17+3)) % 21 - 10 AS INT) AS x,
 CAST(300 - 20*n_nationkey + (c_custkey*(n_nationkey*11+5)) % 17 - 8 AS INT) AS y
 FROM customer JOIN nation ON n_nationkey < 8 WHERE (c_custkey + n_nationkey) % 11 <> 0""",
    "f5_votes": """SELECT l_suppkey % 10 AS image_id, CAST(l_linenumber AS BIGINT) AS term_id, CAST(l_partkey % 16 AS INT) AS y, CAST((l_orderkey*13) % 16 AS INT) AS x,
 CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3, 4""",
    "f6_preds": """SELECT image_id, term_id, r_regionkey AS model_id, x AS x_true, y AS y_true,
 CAST(x + (image_id*term_id*7 + r_regionkey*5) % 9 - 4 AS INT) AS x_pred, CAST(y + (image_id*3 + term_id + r_regionkey) % 7 - 3 AS INT) AS y_pred
 FROM f4_landmarks JOIN region ON r_regionkey < 3""",
    "f7_samples": "SELECT vec_id AS sample_id, label, CAST((label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS INT) AS pred FROM embeddings",
    "f8_subwindows": """SELECT l_suppkey AS image_id, l_orderkey AS sw, CAST(l_linenumber AS BIGINT) AS tree_id, CAST(l_partkey % 32 AS BIGINT) AS leaf,
 CAST(l_partkey % 4 AS INT) AS class_idx, CAST(l_discount AS DOUBLE) AS p FROM lineitem""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, over the Parquet tables of sf_dir. Views are temporary and are replaced by each call."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    spark.sql(EMB_LONG_SPARK).createOrReplaceTempView("emb_long")
    for view, sql in VIEWS.items():
        df = spark.sql(sql)
        df.createOrReplaceTempView(view)
        if view == name:
            return df
    raise KeyError(name)


def oracle(query: str, *names: str) -> str:
    """DuckDB SQL of a query over derived tables: those it names, and what they need, as common table expressions."""
    need, order = set(), ["emb_long", *VIEWS]

    def add(name: str) -> None:
        need.add(name)
        for other in order:
            if other not in need and name in VIEWS and other in VIEWS[name]:
                add(other)

    for name in names:
        add(name)
    ctes = [f"{v} AS ({EMB_LONG_DUCKDB if v == 'emb_long' else VIEWS[v]})" for v in order if v in need]
    body = query.strip()
    recursive = body.startswith("WITH RECURSIVE ")
    if body.startswith("WITH "):
        body = ", " + body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
