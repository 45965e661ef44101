"""Resumable and stateful operators.

Logs are append-only tables; a finished unit is known by its key, so repeated micro-batches and restarts change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resumable_map(items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, log: str, success: str = "ok") -> int:
    """Run ``work`` on the items without a finished row in the log table; append results, then the log. The number of new log rows.

    ``work`` returns the key, ``status`` and result columns. Rows of another status are tried again in the next run. If a
    run ends between results and log, the next writes those results again: readers keep the last per key (``latest``).
    """
    spark = items.sparkSession
    done = _table(spark, log)
    todo = items if done is None else items.join(done.filter(F.col("status") == success).select(key).distinct(), key, "left_anti")
    from ..storage import staged

    got = staged(work(todo), "results")
    got.filter(F.col("status") == success).drop("status").write.mode("append").parquet(out)
    got.select(key, "status").write.mode("append").parquet(log)
    return got.count()


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception:
        return None


def latest(stream: DataFrame, key: str, order: str, columns: list[str], table: str, checkpoint: str, available_now: bool = True):
    """Keep the latest row per key of a stream in a Parquet table with versions: each micro-batch merges its rows and writes a new one.

    A repeated micro-batch writes the same version again. ``table``/v=<batch>; ``read_latest`` reads the last.
    """

    def merge(df: DataFrame, batch: int) -> None:
        old = read_latest(df.sparkSession, table, before=batch)
        new = df.select(key, order, *columns)
        both = new if old is None else old.select(key, order, *columns).unionByName(new)
        best = both.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("r")).select(key, "r.*")
        best.write.mode("overwrite").parquet(f"{table}/v={batch:010d}")

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_latest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(table)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    names = [n for n in names if n.startswith("v=") and (before is None or int(n[2:]) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{table}/{names[-1]}") if names else None


def gate_stream(stream: DataFrame, run: str, step: str, values: list[str], window: int, threshold: float) -> DataFrame:
    """(run, step, open) of each step of a stream of reward means: once the means of the last ``window`` steps of all values reach the threshold, open for good.

    State per run: the window and the latch. Steps of a micro-batch are taken in order; steps that come late count when
    they come.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def f(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hist, is_open = state.get if state.exists else ([], False)
        hist = [list(h) for h in hist]
        for pdf in pdfs:
            out = []
            for r in pdf.sort_values(step).to_dict("records"):
                hist = [*hist, [float(r[v]) for v in values]][-window:]
                full = len(hist) >= window
                is_open = is_open or full and all(sum(h[i] for h in hist) / len(hist) >= threshold for i in range(len(values)))
                out.append((key[0], r[step], is_open))
            yield pd.DataFrame(out, columns=[run, step, "open"])
        state.update((hist, is_open))

    return stream.groupBy(run).applyInPandasWithState(f, f"{run} {kinds[run]}, {step} {kinds[step]}, open boolean", "hist array<array<double>>, open boolean", "append", GroupStateTimeout.NoTimeout)


def bounded_queue(stream: DataFrame, queue: str, item: str, order: str, capacity: int) -> DataFrame:
    """(queue, item, event) of a stream of puts: each put, and "dropped" for the oldest item when a queue is full.

    State per queue: at most ``capacity`` items.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def f(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in pdfs:
            out = []
            for x in pdf.sort_values(order)[item]:
                if len(held) >= capacity:
                    out.append((key[0], held.pop(0), "dropped"))
                held.append(str(x))
                out.append((key[0], str(x), "put"))
            yield pd.DataFrame(out, columns=[queue, item, "event"])
        state.update((held,))

    return stream.groupBy(queue).applyInPandasWithState(f, f"{queue} {kinds[queue]}, {item} string, event string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def queue_events(df: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """The batch form: ``dropped`` is true for puts that are pushed out later, that is all but the last ``capacity`` of a queue without gets."""
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy(queue).orderBy(F.desc(order)))
    return df.withColumn("dropped", back > capacity)


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of the order, with their number ``__p``, written once."""
    from ..storage import staged

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranges")


def staleness(df: DataFrame, order: str, event: str, required: int, threshold: float, sync_every: int) -> DataFrame:
    """``df`` with ``in_flight`` since the last sync and ``paused``: the number has reached required * (threshold + 1) * sync_every.

    Events: "sample" counts, "sync" starts anew. The log is counted in ranges of its order; what a range takes over
    from those before it is one number.
    """
    from pyspark.sql import Window

    d = _ranges(df, order)
    is_sync, is_sample = (F.col(event) == "sync").cast("int"), (F.col(event) == "sample").cast("int")
    within = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__e", F.sum(F.coalesce(is_sync, F.lit(0))).over(within))
    last = d.groupBy("__p", "__e").agg(F.sum(F.coalesce(is_sample, F.lit(0))).alias("n")).groupBy("__p").agg(F.max(F.struct("__e", "n")).alias("x"))
    carried, starts = 0, []
    for r in last.orderBy("__p").collect():  # one row per range
        starts.append((r["__p"], carried))
        carried = r["x"]["n"] + (carried if r["x"]["__e"] == 0 else 0)
    d = d.join(F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __s long")), "__p")
    n = F.sum(F.coalesce(is_sample, F.lit(0))).over(Window.partitionBy("__p", "__e").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("in_flight", n + F.when(F.col("__e") == 0, F.col("__s")).otherwise(0)).drop("__e", "__p", "__s")
    return d.withColumn("paused", F.col("in_flight") >= int(required * (threshold + 1) * sync_every))


def kl_controller(df: DataFrame, order: str, value: str, start: float, target: float, horizon: float, steps: int) -> DataFrame:
    """(order, coefficient) after each step: it is multiplied by 1 + the relative error, clipped to 0.2, times steps over horizon.

    The factors don't depend on the coefficient, so it is a running product, taken in ranges of the order. A null value
    leaves it as it is.
    """
    from pyspark.sql import Window

    d = _ranges(df.select(order, value), order)
    error = F.least(F.greatest(F.col(value) / target - 1, F.lit(-0.2)), F.lit(0.2))
    d = d.withColumn("__f", F.when(F.col(value).isNull(), 1.0).otherwise(1 + error * steps / horizon))
    now, starts = float(start), []
    for r in d.groupBy("__p").agg(F.product("__f").alias("f")).orderBy("__p").collect():  # one row per range
        starts.append((r["__p"], now))
        now *= r["f"]
    d = d.join(F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __s double")), "__p")
    run = F.product("__f").over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.select(order, (F.col("__s") * run).alias("coefficient"))


class GrowingTable:
    """A table that grows by what a generator makes after each batch; reads see all that was committed before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        return _table(self.spark, self.path)

    def on_batch_end(self, batch: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> None:
        generate(batch).write.mode("append").parquet(self.path)


def rounds(generate: Callable[[int, DataFrame | None], DataFrame], accept: Callable[[DataFrame], DataFrame], path: str, spark: SparkSession, quota: int, patience: int = 3) -> int:
    """Generate, accept and append until the quota is met; ``patience`` rounds without progress end with an error. The number of accepted rows.

    Between rounds the accepted rows are a written table.
    """
    have, idle, k = 0, 0, 0
    while have < quota:
        accept(generate(k, _table(spark, path))).write.mode("append").parquet(path)
        now = spark.read.parquet(path).count()
        idle = 0 if now > have else idle + 1
        have, k = now, k + 1
        if idle >= patience:
            raise RuntimeError(f"{patience} rounds without progress at {have} of {quota}")
    return have


def audited(groups: DataFrame, key: str, audit: Callable[[DataFrame, int], DataFrame], regenerate: Callable[[DataFrame, DataFrame, int], DataFrame], most: int = 3, passed: str = "PASS") -> tuple[DataFrame, DataFrame]:
    """Groups as they are after up to ``most`` rounds of regeneration, and the latest audit of each (key, label, ...).

    A round regenerates what hasn't passed (given its audit) and audits it again; what a round doesn't return keeps its group and its last audit. Groups
    that fail every round stay in the result with their label, so nothing is lost.
    """
    from ..storage import staged

    current = staged(groups, "groups")
    latest = staged(audit(current, 0), "audits")
    for k in range(1, most + 1):
        bad = staged(latest.filter(F.coalesce(F.col("label") != passed, F.lit(True))).select(key), "failed")
        if bad.isEmpty():
            break
        failed = current.join(bad, key, "left_semi")
        new = staged(regenerate(failed, latest.join(bad, key, "left_semi"), k), "regenerated")
        current = staged(current.join(new.select(key), key, "left_anti").unionByName(new), "groups")
        again = staged(audit(current.join(bad, key, "left_semi"), k), "audits")
        latest = staged(latest.join(again.select(key), key, "left_anti").unionByName(again), "audits")
    return current, latest


def waves(items: DataFrame, key: str, work: Callable[[DataFrame, int], DataFrame], out: str, log: str, capacity: int, chunk: int = 8, small: int = 1, after: int = 2, patience: int = 3, success: str = "ok") -> int:
    """Run ``work`` on waves of up to ``capacity`` pending items until none is left; the number of finished items.

    ``work`` gets the items with ``chunk`` (how much of an item a call should do: ``small`` from ``after`` errors on) and the wave's number, and returns the
    key, ``status`` and result columns. Results and log are appended per wave; what was done before a crash isn't
    done again. ``patience`` waves in a row without a finished item end with an error: what always fails isn't tried for ever.
    """
    from ..operators.batch import INDEX, with_index
    from ..storage import staged

    spark = items.sparkSession
    k = idle = 0
    while True:
        seen = _table(spark, log)
        d = items
        if seen is not None:
            d = d.join(seen.filter(F.col("status") == success).select(key).distinct(), key, "left_anti")
            errors = seen.filter(F.col("status") != success).groupBy(key).agg(F.count("*").alias("errors"))
            d = d.join(errors, key, "left")
        else:
            d = d.withColumn("errors", F.lit(0).cast("long"))
        d = d.withColumn("errors", F.coalesce("errors", F.lit(0))).withColumn("chunk", F.when(F.col("errors") >= after, small).otherwise(chunk))
        wave = staged(with_index(d, "errors", key).filter(F.col(INDEX) < capacity).drop(INDEX), "wave")  # those that failed least first
        if wave.isEmpty():
            return spark.read.parquet(log).filter(F.col("status") == success).select(key).distinct().count() if seen is not None else 0
        got = staged(work(wave, k), "results")
        got.filter(F.col("status") == success).drop("status").write.mode("append").parquet(out)
        got.select(key, "status").write.mode("append").parquet(log)
        idle = idle + 1 if got.filter(F.col("status") == success).isEmpty() else 0
        k += 1
        if idle >= patience:
            raise RuntimeError(f"{patience} waves without a finished item")


def even_schedule(df: DataFrame, arrival: str, order: str, interval: float) -> DataFrame:
    """``df`` with ``scheduled``: calls in order, each at its arrival or ``interval`` seconds after the one before, whichever is later.

    The k-th call's time is k * interval plus the largest arrival less j * interval of the calls up to it: a running maximum, taken in ranges of the order.
    """
    from pyspark.sql import Window

    from ..operators.batch import INDEX, with_index

    d = with_index(df, order)
    slack = F.col(arrival) - F.col(INDEX) * interval
    d = _ranges(d.withColumn("__s", slack), INDEX)
    top, starts = None, []
    for r in d.groupBy("__p").agg(F.max("__s").alias("s")).orderBy("__p").collect():  # one row per range
        starts.append((r["__p"], top))
        top = r["s"] if top is None or r["s"] is not None and r["s"] > top else top
    d = d.join(F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __t double")), "__p")
    run = F.max("__s").over(Window.partitionBy("__p").orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("scheduled", F.greatest(run, F.col("__t")) + F.col(INDEX) * interval).drop("__s", "__t", "__p", INDEX)


def token_bucket(stream: DataFrame, bucket: str, item: str, time: str, rate: float) -> DataFrame:
    """(bucket, item, granted) of a stream of requests: a bucket holds up to ``rate`` tokens, gains ``rate`` a second and gives one for each granted request.

    State per bucket: its tokens and its last time. Requests of a micro-batch are taken by time; late ones gain nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def f(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else (float(rate), None)
        for pdf in pdfs:
            out = []
            for r in pdf.sort_values([time, item]).to_dict("records"):
                now = float(r[time])
                held = min(rate, held + (max(0.0, now - last) * rate if last is not None else 0.0))
                last = now if last is None else max(last, now)
                ok = held >= 1
                held -= ok
                out.append((key[0], r[item], ok))
            yield pd.DataFrame(out, columns=[bucket, item, "granted"])
        state.update((float(held), last))

    return stream.groupBy(bucket).applyInPandasWithState(f, f"{bucket} {kinds[bucket]}, {item} {kinds[item]}, granted boolean", "held double, last double", "append", GroupStateTimeout.NoTimeout)
