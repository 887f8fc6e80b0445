"""STR2: conversation state per thread, to which every turn appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor


def fold_threads(items: DataFrame) -> DataFrame:
    """Batch form: items and distinct agents per thread, and the order agents first ran in.

    ``items(thread_id, seq, agent)``. Repeats are folded by partial aggregation, so only one
    row per thread and agent is collected, whatever the length of a thread.
    """
    per_agent = items.groupBy("thread_id", "agent").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "agent")))
    return per_agent.groupBy("thread_id").agg(F.transform(ordered, lambda s: s["agent"]).alias("ran"), F.sum("n").alias("items"))


ITEMS = "thread_id string, item_no bigint, seq bigint, agent string, first_run boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"


class ThreadState(StatefulProcessor):
    """What a thread has so far: the number of its items, and how often each agent ran."""

    def init(self, handle) -> None:
        self.items = handle.getValueState("items", "n bigint")
        self.ran = handle.getMapState("ran", "agent string", "n bigint")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["seq", "agent"], kind="stable")
        before = self.items.get()[0] if self.items.exists() else 0
        counts = new["agent"].value_counts(dropna=False)
        known = {}
        for agent, n in counts.items():
            name = ("" if pd.isna(agent) else str(agent),)
            known[name[0]] = self.ran.containsKey(name)
            self.ran.updateValue(name, ((self.ran.getValue(name)[0] if known[name[0]] else 0) + int(n),))
        self.items.update((before + len(new),))
        agents = new["agent"].fillna("")
        yield pd.DataFrame({"thread_id": key[0], "item_no": range(before + 1, before + len(new) + 1), "seq": new["seq"].to_numpy(), "agent": new["agent"].to_numpy(),
                            "first_run": (~agents.duplicated() & ~agents.map(known).astype(bool)).to_numpy()})

    def close(self) -> None:
        pass


def thread_items(items: DataFrame) -> DataFrame:
    """Stream of ``items(thread_id, seq, agent)`` -> place of every item in its thread, and whether its agent is the first of its kind there.

    The state of a thread lives in the state store, keyed by thread and agent, and is updated by what arrives; nothing that came earlier
    is read again, so a batch costs what it holds. Items of one batch are ordered by seq, batches by arrival. A null agent is an
    agent of its own, the empty name. The items of one thread within one batch are sorted together: bound a batch by its files.
    """
    return items.select("thread_id", F.col("seq").cast("bigint").alias("seq"), "agent").groupBy("thread_id").transformWithStateInPandas(
        ThreadState(), ITEMS, "append", "none")


def run_threads(items: DataFrame, folder: str, checkpoint: str) -> None:
    """Append whatever has arrived to ``folder``, then stop. Started again with its checkpoint it goes on where it was."""
    spark = items.sparkSession
    store = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = thread_items(items).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, store)
