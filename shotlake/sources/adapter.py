"""The catalogue's tables from the star-schema tables: sources from orders, shots from their lines, and so on."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folders_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """(custkey, category): REGION/NATION/SEGMENT."""
    place = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("place"))
    return read(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("custkey"), F.concat_ws("/", "place", "c_mktsegment").alias("category"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    status = F.create_map(*(F.lit(x) for x in ("F", "indexed", "O", "pending", "P", "needs_review")))
    ext = F.when(F.col("o_orderpriority").startswith("1"), ".jpg").when(F.col("o_orderpriority").startswith("5"), ".txt").otherwise(".mp4")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("source_id"),
        F.concat(F.lit("lib"), (F.col("o_custkey") % 4).cast("string")).alias("workspace_id"),
        F.concat(F.lit("take_"), F.col("o_orderkey").cast("string"), ext).alias("filename"),
        F.when(ext == ".jpg", "image").when(ext == ".mp4", "video").alias("media_kind"),
        status[F.col("o_orderstatus")].alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_totalprice") / 1000).alias("duration_s"),
        F.round(F.col("o_totalprice") * 1000).cast("long").alias("filesize_bytes"),
        (F.lit(640) + F.col("o_orderkey") % 4 * 640).cast("int").alias("width"),
        F.md5(F.concat_ws("|", (F.col("o_custkey") % 500).cast("string"), F.date_format("o_orderdate", "yyyy-MM")).cast("binary")).alias("content_hash"),
        F.col("o_custkey").alias("custkey"),
    )
    return rows.join(folders_of_customers(spark, d), "custkey").drop("custkey")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def shots(spark: SparkSession, d: str) -> DataFrame:
    """A shot per order line, numbered and laid end to end within its source."""
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    w = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    rows = line.withColumn("i", F.row_number().over(w) - 1).withColumn("end_s", F.sum("l_quantity").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    pick = lambda c, *kv: F.create_map(*(F.lit(x) for x in kv))[F.col(c)]
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("i").cast("string")).alias("shot_id"),
        F.col("l_orderkey").cast("string").alias("source_id"),
        F.col("i").alias("shot_index"),
        (F.col("end_s") - F.col("l_quantity")).alias("start_s"),
        "end_s",
        F.col("l_quantity").alias("duration_s"),
        F.round(F.abs("l_discount") * 10, 2).alias("confidence"),
        F.lower("p_type").alias("action"),
        F.col("p_brand").alias("setting"),
        pick("l_returnflag", "A", "wide", "N", "medium", "R", "close_up").alias("shot_type"),
        pick("l_linestatus", "O", "static", "F", "pan").alias("camera_movement"),
        F.split("p_name", " ").alias("tags"),
        F.array(F.when(F.col("p_size") > 25, "calm").otherwise("tense"), F.when(F.col("p_size") % 2 == 0, "warm").otherwise("cool")).alias("mood"),
        F.array_compact(F.array(F.when(F.abs("l_tax") >= 0.06, F.lit("shaky")), F.when(F.abs("l_tax") <= 0.01, F.lit("blurred")), F.when(F.col("l_linenumber") > 5, F.lit("dark")))).alias("quality_flags"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("on"), "p_brand").alias("caption"),
        pick("l_returnflag", "A", "indexed", "N", "needs_review", "R", "failed").alias("status"),
        (F.col("l_linenumber") == 1).alias("top_pick"),
        F.concat(F.lit("1."), (F.col("p_size") % 12).cast("string")).alias("analysis_version"),
    )


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """A metered call per event."""
    e = read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("call_id"), F.concat(F.lit("lib"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"),
        F.col("value").alias("cost_usd"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"),
    )


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Which shot was used in which project: the last purchase or click of a user stands for its project's use."""
    e = read(spark, d, "events").filter(F.col("event_type").isin("purchase", "click"))
    rows = e.select((F.floor(F.col("event_id") / 4)).cast("string").alias("source_id"), F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("project"), F.when(F.col("event_type") == "click", F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string"))).alias("beat"), F.col("ts").alias("used_at"))
    rows = rows.withColumn("shot_id", F.concat(F.col("source_id"), F.lit("-0")))
    return rows.groupBy("shot_id", "project").agg(F.max_by(F.struct("beat", "used_at"), "used_at").alias("x")).select("shot_id", "project", "x.beat", "x.used_at")


#: The same tables as DuckDB common table expressions.
CTE = {
    "sources": """sources AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'lib' || (o_custkey % 4) AS workspace_id,
               'take_' || o_orderkey || x.ext AS filename,
               CASE x.ext WHEN '.jpg' THEN 'image' WHEN '.mp4' THEN 'video' END AS media_kind,
               CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'needs_review' END AS status,
               o_orderdate AS created_at, o_totalprice / 1000 AS duration_s, CAST(round(o_totalprice * 1000) AS BIGINT) AS filesize_bytes,
               CAST(640 + o_orderkey % 4 * 640 AS INT) AS width,
               md5((o_custkey % 500) || '|' || strftime(o_orderdate, '%Y-%m')) AS content_hash,
               r_name || '/' || n_name || '/' || c_mktsegment AS category
        FROM orders o, LATERAL (SELECT CASE WHEN o.o_orderpriority LIKE '1%' THEN '.jpg' WHEN o.o_orderpriority LIKE '5%' THEN '.txt' ELSE '.mp4' END AS ext) x
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "shots": """lines AS (
        SELECT *, row_number() OVER w - 1 AS i, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS end_s FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)),
      shots AS (
        SELECT l_orderkey || '-' || i AS shot_id, CAST(l_orderkey AS VARCHAR) AS source_id, i AS shot_index, end_s - l_quantity AS start_s, end_s,
               l_quantity AS duration_s, round(abs(l_discount) * 10, 2) AS confidence, lower(p_type) AS action, p_brand AS setting,
               CASE l_returnflag WHEN 'A' THEN 'wide' WHEN 'N' THEN 'medium' WHEN 'R' THEN 'close_up' END AS shot_type,
               CASE l_linestatus WHEN 'O' THEN 'static' WHEN 'F' THEN 'pan' END AS camera_movement, string_split(p_name, ' ') AS tags,
               [CASE WHEN p_size > 25 THEN 'calm' ELSE 'tense' END, CASE WHEN p_size % 2 = 0 THEN 'warm' ELSE 'cool' END] AS mood,
               list_filter([CASE WHEN abs(l_tax) >= 0.06 THEN 'shaky' END, CASE WHEN abs(l_tax) <= 0.01 THEN 'blurred' END, CASE WHEN l_linenumber > 5 THEN 'dark' END], lambda f: f IS NOT NULL) AS quality_flags,
               p_name || ' ' || lower(p_type) || ' on ' || p_brand AS caption,
               CASE l_returnflag WHEN 'A' THEN 'indexed' WHEN 'N' THEN 'needs_review' WHEN 'R' THEN 'failed' END AS status,
               l_linenumber = 1 AS top_pick, '1.' || (p_size % 12) AS analysis_version
        FROM lines JOIN part ON l_partkey = p_partkey)""",
    "ledger": """ledger AS (
        SELECT event_id AS call_id, 'lib' || (user_id % 4) AS workspace_id, ts AS at, event_type AS kind, value AS cost_usd,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_type <> 'error' AS ok, 'job' || user_id AS job_id FROM events)""",
    "usage": """usage AS (
        SELECT (event_id // 4) || '-0' AS shot_id, 'p' || (user_id % 20) AS project,
               arg_max({'b': CASE WHEN event_type = 'click' THEN 'b' || (event_id % 5) END}, ts).b AS beat, max(ts) AS used_at
        FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2)""",
}


def oracle(sql: str, *tables: str) -> str:
    """sql over the named tables of the catalogue."""
    return f"WITH {', '.join(CTE[t] for t in tables)} {sql}"
