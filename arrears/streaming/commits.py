"""The commit stream (§2.13): deduplicated commits, developer counts, the count-based window and ranking by micro-batch.

Every commit is processed (D-list: the reference's monitor sees only the newest one of a poll; `head_only` gives that). A
watermark bounds the state of the deduplication.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

POLL = "30 seconds"


def distinct_commits(stream: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """T2."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def developer_counts(stream: DataFrame) -> DataFrame:
    """T4: running counts by developer and file (update or complete mode); no expiry, as interest is cumulative."""
    return stream.select("author", F.explode("files").alias("file")).groupBy("author", "file").agg(F.count(F.lit(1)).alias("mods"))


def count_window(stream: DataFrame, *, size: int = 50, key: str = "repo") -> DataFrame:
    """For each commit of a repository the number of commits in its window of the last `size`, and the oldest index there.

    The state is a counter and the window's hashes, oldest first; rows of a batch are taken in order of time and hash.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, window = state.get if state.exists else (0, [])
        window = list(window)
        rows = pd.concat(list(batches)).sort_values(["ts", "hash"])
        out = []
        for h in rows["hash"]:
            window = [*window, h][-size:]
            n += 1
            out.append((k[0], h, n, len(window), window[0]))
        state.update((n, window))
        yield pd.DataFrame(out, columns=[key, "hash", "index", "in_window", "oldest"])

    kind, hash_kind = dict(stream.dtypes)[key], dict(stream.dtypes)["hash"]
    return stream.select(key, "hash", "ts").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, hash {hash_kind}, index long, in_window int, oldest {hash_kind}", f"n long, window array<{hash_kind}>", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> None:
    """Processes what is there, batch by batch, and ends."""
    query = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def watch(stream: DataFrame, rank: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, *, head_only: bool = False) -> StreamingQuery:
    """Every 30 seconds the new commits (or only the newest) are joined with the static tables that `rank` holds, and
    what comes out goes to `sink`; stop() ends it."""

    def batch(df: DataFrame, n: int) -> None:
        if head_only:
            df = df.orderBy(F.desc("ts"), F.desc("hash")).limit(1)
        sink(rank(df), n)

    return distinct_commits(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=POLL).start()


def since(df: DataFrame, seconds: int) -> DataFrame:
    """Commits of the last seconds."""
    return df.where(F.col("ts") > F.current_timestamp() - F.make_interval(secs=F.lit(seconds)))
