"""Streams of observations: capture, co-activation of what is recent, windowed counts, triggers and timers.

capture is stateless and the same function serves batches and streams. Recent co-activation and
the trigger of summaries keep a few numbers of each project as state; stretches of activity keep
theirs until the watermark has passed them. Windowed counts use a
watermark, so their state is bounded by its delay.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions.text import has_private_tags, has_secret, strip_private_tags
from recollect.sources.storage import fresh


def captured(observations: DataFrame) -> DataFrame:
    """What is worth storing: a summary, details of at most 200 characters, nothing private."""
    summary = F.concat(F.lit("used "), "type", F.lit(" on "), F.col("project_id").cast("string"))
    kept = observations.withColumns({"summary": summary, "details": F.substring("details", 1, 200)})
    return kept.filter((F.col("type") != "error") & ~has_private_tags(F.col("summary")) & ~has_secret(F.col("summary")))


def captured_hooks(hooks: DataFrame) -> DataFrame:
    """Observations from the events of a session: prompts, uses of tools, changes of files, errors.

    hooks: id, kind (prompt, tool, file, error), project, name (of the tool, file or context), text
    (the prompt, kind of change or message), args, result, created_at. Private parts of prompts are
    replaced; what still holds something private is not captured.
    """
    # types, actions, tags and wording of captured events (fixed values)
    kind, cut = F.col("kind"), lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
    prompt = cut(strip_private_tags(F.col("text")), 500)
    by = lambda prompts, tools, files, errors: F.when(kind == "prompt", prompts).when(kind == "tool", tools).when(kind == "file", files).when(kind == "error", errors)
    tags = lambda *x: F.array(*[F.lit(t) if isinstance(t, str) else t for t in ("auto-captured", *x)])
    name, text = F.col("name"), F.col("text")
    made = hooks.select(
        "id", F.col("project").alias("project_id"), by(F.lit("insight"), F.lit("tool_use"), F.lit("file_change"), F.lit("error")).alias("type"),
        by(F.lit("user_submitted_prompt"), name, text, F.lit("error_occurred")).alias("action"), by(F.col("project"), F.col("project"), name, name).alias("target"),
        by(prompt, F.concat(F.lit("Tool "), name, F.lit(" executed with args: "), F.coalesce(cut(F.col("args"), 200), F.lit("none"))), F.concat(F.lit("File "), text, F.lit(": "), name), F.concat(F.lit("Error in "), name, F.lit(": "), text)).alias("summary"),
        F.when(kind == "tool", F.coalesce(cut(F.col("result"), 200), F.lit("no result"))).alias("result"), by(tags("user-prompt"), tags("tool-use", name), tags("file-change", text), tags("error")).alias("tags"), "created_at",
    )
    return made.filter(F.col("type").isNotNull() & ~has_private_tags(F.col("summary")) & ~has_secret(F.col("summary")))


def _in_order(frames: Iterator[pd.DataFrame]) -> list[int]:
    """Ids of all rows of a group in this batch of the stream, in order of time; Arrow may have cut them into several frames."""
    whole = pd.concat(list(frames))
    return whole.sort_values(["created_at", "id"])["id"].tolist()


def _recent_pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, last: int) -> Iterator[pd.DataFrame]:
    recent = list(state.get[0]) if state.exists else []
    pairs: dict[tuple[int, int], int] = {}
    for i in _in_order(frames):
        for other in recent:
            if other != i:
                for pair in ((i, other), (other, i)):
                    pairs[pair] = pairs.get(pair, 0) + 1
        recent = [*recent, i][-(last - 1) :] if last > 1 else []
    state.update((recent,))
    if pairs:
        yield pd.DataFrame([(key[0], a, b, n) for (a, b), n in pairs.items()], columns=["project_id", "source", "target", "weight"])


def coactivation_stream(observations: DataFrame, last: int = 5) -> DataFrame:
    """Edges between each observation and the up to last - 1 before it in its project, as they arrive."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _recent_pairs(key, frames, state, last)

    return observations.select("project_id", "id", "created_at").groupBy("project_id").applyInPandasWithState(step, "project_id long, source long, target long, weight long", "recent array<long>", "append", GroupStateTimeout.NoTimeout)


def _nth(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, n: int) -> Iterator[pd.DataFrame]:
    seen, due = state.get[0] if state.exists else 0, []
    for i in _in_order(frames):
        seen += 1
        if seen % n == 0:
            due.append((key[0], i, seen))
    state.update((seen,))
    if due:
        yield pd.DataFrame(due, columns=["project_id", "id", "count"])


def every_nth_stream(observations: DataFrame, n: int = 10) -> DataFrame:
    """(project_id, id, count): each n-th observation of a project as it arrives, which makes a summary due."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _nth(key, frames, state, n)

    return observations.select("project_id", "id", "created_at").groupBy("project_id").applyInPandasWithState(step, "project_id long, id long, count long", "seen long", "append", GroupStateTimeout.NoTimeout)


def timer(spark: SparkSession, every: str, job: Callable[[], None], name: str) -> StreamingQuery:
    """Run job at once and then every so often, never twice at a time; a failure is logged and the next run takes place.

    The clock is a stream without data, so the timer lives and stops with the session's streams.
    """

    def run(*_) -> None:
        try:
            job()
        except Exception:  # one failed run must not end the timer
            logging.getLogger(__name__).exception("timer %s", name)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.queryName(name).foreachBatch(run).option("checkpointLocation", fresh(spark, f"timer-{name}")).trigger(processingTime=every).start()


def publish(messages: DataFrame, topic: str) -> None:
    """Append messages to a topic, a folder of JSON lines."""
    messages.write.mode("append").json(topic)


def subscribe(spark: SparkSession, topic: str, schema: str) -> DataFrame:
    """A topic's messages as a stream, those published before included."""
    return spark.readStream.schema(schema).json(topic)


def windowed_counts(observations: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Count and sum of values per window and type; late rows within the delay are counted."""
    timed = observations.withColumn("at", F.col("created_at").cast("timestamp"))
    if observations.isStreaming:
        timed = timed.withWatermark("at", delay)
    counts = timed.groupBy(F.window("at", width).alias("w"), "type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").cast("string").alias("start"), "type", "n", F.round("total", 4).alias("total"))


def sessions(observations: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Sessions of a project: activity without a longer gap."""
    timed = observations.withColumn("at", F.col("created_at").cast("timestamp"))
    s = timed.groupBy("project_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("project_id", F.date_trunc("second", F.col("w.start").cast("timestamp_ntz")).cast("timestamp_ntz").cast("string").alias("start"), "n")


def quiet_stream(observations: DataFrame, gap: float = 600.0, delay: str = "1 hour") -> DataFrame:
    """(project_id, start, end, n): stretches of activity of a project, given out once it has been quiet for `gap` seconds.

    With a gap of two seconds this is the debounce of captured changes, with minutes the end of a
    session, with days that of an idle project. Times are those of the events: a stretch is given out when the
    watermark, the latest time less the delay, has passed its end and the gap, and its state goes.
    Until then late rows join stretches, or join two to one; later ones are dropped. State is a few
    numbers for each open stretch, and rows are taken as they come, whatever a project has in a batch.
    """
    width = int(gap * 1000)

    def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for start, end, n in sorted(spans):
            if out and start - out[-1][1] <= width:
                out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
            else:
                out.append((start, end, n))
        return out

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        spans = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                times = frame["ms"].sort_values()
                cut = (times.diff() > width).cumsum()
                new = times.groupby(cut).agg(["min", "max", "count"])
                spans = merged([*spans, *new.itertuples(index=False, name=None)])
        done = [s for s in spans if s[1] + width < mark]
        left = [s for s in spans if s[1] + width >= mark]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            state.setTimeoutTimestamp(max(min(s[1] for s in left) + width, mark + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([(key[0], *s) for s in done], columns=["project_id", "start", "end", "n"])

    timed = observations.select("project_id", F.col("created_at").cast("timestamp").alias("at")).withWatermark("at", delay)
    slim = timed.withColumn("ms", F.unix_millis("at"))
    found = slim.groupBy("project_id").applyInPandasWithState(step, "project_id long, start long, end long, n long", "starts array<long>, ends array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    moment = lambda c: F.timestamp_millis(F.col(c)).cast("timestamp_ntz").cast("string").alias(c)
    return found.select("project_id", moment("start"), moment("end"), "n")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives out about the data at hand, as rows of a Parquet folder all executors share.

    The stream runs until its input is used up; its checkpoint stays beside its output.
    """
    spark = stream.sparkSession
    path = fresh(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of observations."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, for it may be a file or a folder
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("type"), "value", F.col("props").alias("details"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
