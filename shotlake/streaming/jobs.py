"""Rolling spend, runs, pass rates and change data as Structured Streaming, each with the batch form that it must equal."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DELAY = "1 hour"


def spend_windows(calls: DataFrame, length: str = "24 hours", slide: str = "6 hours") -> DataFrame:
    """Spend per library in sliding windows."""
    return calls.groupBy("workspace_id", F.window("at", length, slide).alias("w")).agg(F.sum("cost_usd").alias("usd"), F.count("*").alias("calls")).select("workspace_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), F.round("usd", 4).alias("usd"), "calls")


def runs(calls: DataFrame, gap: str = "20 minutes") -> DataFrame:
    """A run of a library ends when nothing comes for the gap: spend per run."""
    return calls.groupBy("workspace_id", F.session_window("at", gap).alias("w")).agg(F.sum("cost_usd").alias("usd"), F.count("*").alias("calls")).select("workspace_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), F.round("usd", 4).alias("usd"), "calls")


def outcomes(calls: DataFrame, length: str = "10 minutes") -> DataFrame:
    """Outcomes in tumbling windows."""
    return calls.groupBy(F.window("at", length).alias("w")).agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("refused")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "passed", "refused")


def term_counts(calls: DataFrame) -> DataFrame:
    """Candidates and their counts; as a stream in complete or update mode."""
    return calls.groupBy(F.concat_ws("_", "kind", (F.col("tokens") % 10).cast("string")).alias("term")).agg(F.count("*").alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def new_files(listing: DataFrame, at: str = "at", key: str = "key", within: str = "1 day") -> DataFrame:
    """Each file once by content key; for a stream, within the watermark."""
    settled = listing.filter("size > 0")
    return settled.withWatermark(at, within).dropDuplicatesWithinWatermark([key]) if listing.isStreaming else settled.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(at))).filter("_r = 1").drop("_r")


def pass_rates(calls: DataFrame, window: str = "30 minutes", slide: str = "10 minutes", least: int = 5) -> DataFrame:
    """Share of calls that went through, in windows with enough of them."""
    return calls.groupBy(F.window("at", window, slide).alias("w")).agg(F.avg(F.col("ok").cast("double")).alias("rate"), F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col("w.start").alias("start"), F.round("rate", 6).alias("rate"), "n")


def pace(rates: DataFrame, slow: float = 0.15, fast: float = 0.30) -> DataFrame:
    """slow below the lower mark, fast above the upper, else as before (batch: last change carried on). One row per window, so one task orders them."""
    turn = F.when(F.col("rate") < slow, "slow").when(F.col("rate") > fast, "fast")
    order = W.orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    return rates.withColumn("pace", F.coalesce(F.last(turn, ignorenulls=True).over(order), F.lit("fast")))


def running(calls: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """calls with the sum of value up to each, in order of at and call_id: summed by minute first, so a library's calls spread over tasks."""
    rows = calls.withColumn("_v", value).withColumn("_m", F.date_trunc("minute", "at"))
    order = W.partitionBy(*keys).orderBy("_m")
    before = rows.groupBy(*keys, "_m").agg(F.sum("_v").alias("_s")).withColumn("_b", F.sum("_s").over(order) - F.col("_s")).drop("_s")
    inside = F.sum("_v").over(W.partitionBy(*keys, "_m").orderBy("at", "call_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_i", inside).join(before, [*keys, "_m"]).withColumn(name, F.col("_b") + F.col("_i")).drop("_v", "_m", "_b", "_i")


def cap_crossings(calls: DataFrame, cap: float) -> DataFrame:
    """The first call of each library and day at which the day's spend reaches the cap."""
    rows = running(calls.withColumn("day", F.to_date("at")), ["workspace_id", "day"], F.col("cost_usd"), "spent")
    return rows.filter(F.round("spent", 6) >= cap).groupBy("workspace_id", "day").agg(F.min_by(F.struct("call_id", F.round("spent", 4).alias("spent")), F.struct("at", "call_id")).alias("x")).select("workspace_id", "day", "x.call_id", "x.spent")


def crossing_stream(calls: DataFrame, cap: float) -> DataFrame:
    """cap_crossings() as a stream: state is a day's spend so far of a library, dropped a day after."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        spent, done = state.get if state.exists else (0.0, False)
        rows = pd.concat(list(batches)).sort_values(["at", "call_id"])
        hit = None
        for r in rows.itertuples():
            spent += r.cost_usd
            if not done and round(spent, 6) >= cap:
                hit, done = (*key, int(r.call_id), round(spent, 4)), True
        state.update((spent, done))
        day = pd.Timestamp(key[1])
        state.setTimeoutTimestamp(max(int(day.timestamp() * 1000) + 2 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if hit:
            yield pd.DataFrame([hit], columns=["workspace_id", "day", "call_id", "spent"])

    keyed = calls.withColumn("day", F.to_date("at"))
    return keyed.groupBy("workspace_id", "day").applyInPandasWithState(step, "workspace_id string, day date, call_id long, spent double", "spent double, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def refusals_in_a_row(calls: DataFrame, key: str = "job_id") -> DataFrame:
    """Per library, each stretch without a success: how many different keys were refused in it."""
    rows = running(calls, ["workspace_id"], F.col("ok").cast("int"), "stretch").filter("not ok")
    return rows.groupBy("workspace_id", "stretch").agg(F.count_distinct(key).alias("keys"), F.count("*").alias("refused"), F.min("at").alias("since"))


def closed(rows: DataFrame, calls: DataFrame, stop: str = "stop", delay: Column | None = None) -> DataFrame:
    """Of batch windows, those that a stream with the watermark has emitted when all calls are in."""
    last = calls.agg((F.max("at") - (delay if delay is not None else F.expr(f"INTERVAL {DELAY}"))).alias("_last"))
    return rows.join(F.broadcast(last), F.col(stop) <= F.col("_last")).drop("_last")


def sync(rows: DataFrame, key: str, at: str, folder: str) -> DataFrame:
    """Run a stream of rows over all that is there now: every micro-batch is compared with what was sent, and what is new or changed is sent.

    A row stands for its key's state until a later one by `at`. What was sent is a written table for each batch; the
    next one reads the last. Returns (batch, key, change) of all batches. A batch that is run again writes the same.
    """
    from shotlake.operators.usage import changes, fingerprints

    spark: SparkSession = rows.sparkSession
    out = f"{folder}/sync-{uuid.uuid4().hex}"
    schema = f"{key} {dict(rows.dtypes)[key]}, fingerprint string"

    def batch(df: DataFrame, n: int) -> None:
        sent = spark.read.schema(schema).parquet(f"{out}/sent/{n - 1}") if n else spark.createDataFrame([], schema)
        last = df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), at).alias("x")).select(key, "x.*")
        now = fingerprints(last, key)
        changes(now, sent, key).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/changes/batch={n}")
        now.unionByName(sent.join(now, key, "left_anti")).write.mode("overwrite").parquet(f"{out}/sent/{n}")

    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(batch).start().awaitTermination()
    return spark.read.schema(f"{key} {dict(rows.dtypes)[key]}, change string, batch int").parquet(f"{out}/changes")


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that is there now, each micro-batch to its own folder; the rows of append mode, or the last state."""
    spark: SparkSession = stream.sparkSession
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/rows/batch=*") if mode != "complete" else None
    if rows is None:
        every = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/rows")
        last = every.agg(F.max("batch")).first()[0]
        rows = every.filter(F.col("batch") == last).drop("batch")
    return rows
