"""Continuous updates: a folder as a stream, micro-batches into a graph store, adaptive debounce, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE_MS = 2000
KEEP, GAIN, TARGET_MS, LEAST_MS, MOST_MS, GAPS = 0.7, 0.3, 5000.0, 100.0, 500.0, 10


def watch(spark: SparkSession, root: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, debounce_ms: int = DEBOUNCE_MS, once: bool = False, most_files: int = 1000) -> StreamingQuery:
    """Every new file under root goes to on_batch(files, batch id); files: path, modificationTime, length, content. A batch that was interrupted comes again with its id."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(root)
    writer = files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()


def indexer(root: str, store, project: str) -> Callable[[DataFrame, int], None]:
    """An observer that brings a graph store up to date with the files of a batch: their old rows go, the new ones are added."""
    from lattica.plans.index import index_files
    from lattica.sources.files import EXTENSIONS, language_of

    def on_batch(files: DataFrame, _: int) -> None:
        rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
        text = F.decode("content", "UTF-8")
        code = files.withColumn("filePath", rel).withColumn("language", language_of(rel, text)).where(F.col("language") != "").select("filePath", text.alias("content"), "language", F.sha2("content", 256).alias("hash"))
        if EXTENSIONS and code.limit(1).count():
            index_files(store, code, project)

    return on_batch


def debounce_step(window: float, gaps: list[float], last: float | None, now: float) -> tuple[float, list[float]]:
    """The adaptive window after an event at `now` (ms): a moving average of how much shorter than 5 s the gap was, within 100 to 500 ms; the last 10 gaps are kept."""
    if last is None:
        return window, gaps
    gap = now - last
    return min(MOST_MS, max(LEAST_MS, KEEP * window + GAIN * max(TARGET_MS - gap, 0.0))), (gaps + [gap])[-GAPS:]


def adaptive_debounce(events: DataFrame, key: str, ts: str) -> DataFrame:
    """key, ts, windowMs after each event, with state for each key; on a stream or a static table."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window, last, gaps = state.get if state.exists else (MOST_MS, None, [])
        gaps = list(gaps)
        for frame in frames:
            out = []
            for t in sorted(frame["ms"]):
                window, gaps = debounce_step(window, gaps, last, t)
                last = t
                out.append((k[0], t, window))
            yield pd.DataFrame(out, columns=[key, "ms", "windowMs"])
        state.update((window, last, gaps))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        window, last, gaps, out = MOST_MS, None, [], []
        for t in sorted(frame["ms"]):
            window, gaps = debounce_step(window, gaps, last, t)
            last = t
            out.append((frame[key].iloc[0], t, window))
        return pd.DataFrame(out, columns=[key, "ms", "windowMs"])

    rows = events.select(key, (F.unix_micros(ts) / 1000.0).alias("ms"))
    if not events.isStreaming:
        return rows.groupBy(key).applyInPandas(whole, f"{key} {kind}, ms double, windowMs double")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ms double, windowMs double", "window double, last double, gaps array<double>", "append", "NoTimeout")


class ParseCache:
    """Parsed files by path: all are dropped once there are `most`; a file anew if its size changed by more than half or over 30 % of its lines."""

    def __init__(self, most: int = 100) -> None:
        self.most, self.entries, self.hits = most, {}, 0

    def get(self, path: str, text: str, parse: Callable[[str], object]) -> object:
        old = self.entries.get(path)
        if old and old[0] == text:
            self.hits += 1
            return old[1]
        if len(self.entries) >= self.most and path not in self.entries:
            self.entries.clear()
        value = parse(text)
        self.entries[path] = (text, value)
        return value

    def reusable(self, path: str, text: str) -> bool:
        """Whether the cached parse is near enough for an incremental one."""
        old = self.entries.get(path)
        if not old:
            return False
        a, b = old[0].split("\n"), text.split("\n")
        changed = sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))
        return abs(len(text) - len(old[0])) <= 0.5 * max(1, len(old[0])) and changed <= 0.3 * max(1, len(a))


def events_stream(spark: SparkSession, path: str, schema: T.StructType | str, most_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """start, event_type, n, total for each window and type. A stream gets a watermark; later rows are dropped."""
    df = events.withWatermark("ts", late) if events.isStreaming and late else events
    return df.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming and late else events
    return df.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming and late else events
    return df.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
