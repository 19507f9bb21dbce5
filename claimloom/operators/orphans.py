"""References to records that do not exist: keyed pending-orphan state, kept incrementally.

The state of one reference table is three tables keyed by the referenced key:

* ``refs``      (row_id, key, at): every reference with a key, at its arrival;
* ``stays``     (key, loaded_at, deleted_at): the parent index, one row per stay of a parent;
* ``episodes``  (row_id, key, opened_at, closed_at, on_arrival): the spans in which a reference pointed
  nowhere; ``on_arrival`` is true where the span began with the reference, false where a deletion began it.

``update`` takes new references and new or closed stays. New references probe the index at their own
arrival time; an arriving parent closes the episodes that wait for it; a deletion opens new ones for
the references of its key. Only keys that changed are recomputed.

``advance`` does so on state kept in bucketed tables: it reads and rewrites only the buckets in which the
batch has keys, and adds its references to them. ``replay`` feeds whole tables through it period by
period, each with the references that arrived and the parents that came or went in it.

Null keys are no references. A stay with ``deleted_at <= loaded_at`` is never there. A parent is there
from ``loaded_at`` on and no longer at ``deleted_at``; of stays of a key that begin together the longest
counts. Rows without an arrival time have no moment at which the parent could be missing and are left
out. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.buckets import Buckets, within, years
from claimloom.session import cut, discard

#: Of the two kinds of timestamp an empty state takes that of the first batch.
REFS = "row_id bigint, key bigint, at timestamp_ntz"
STAYS = "key bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
EPISODES = "row_id bigint, key bigint, opened_at timestamp_ntz, closed_at timestamp_ntz, on_arrival boolean"


@dataclass
class OrphanState:
    refs: DataFrame
    stays: DataFrame
    episodes: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        return OrphanState(*(spark.createDataFrame([], s) for s in (REFS, STAYS, EPISODES)))

    @staticmethod
    def read(spark: SparkSession, path: str) -> OrphanState:
        return OrphanState(*(spark.read.parquet(f"{path}/{n}") for n in ("refs", "stays", "episodes")))

    def write(self, path: str) -> None:
        for name in ("refs", "stays", "episodes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def references(rows: DataFrame, row_id: str, key: str, at: str) -> DataFrame:
    return rows.select(
        F.col(row_id).cast("bigint").alias("row_id"), F.col(key).cast("bigint").alias("key"), F.col(at).alias("at")
    ).filter(F.col("key").isNotNull() & F.col("at").isNotNull())


def parent_stays(rows: DataFrame, key: str, loaded_at: str = "loaded_at", deleted_at: str = "deleted_at") -> DataFrame:
    stays = rows.select(F.col(key).cast("bigint").alias("key"), F.col(loaded_at).alias("loaded_at"), F.col(deleted_at).alias("deleted_at"))
    never = F.col("deleted_at").isNotNull() & (F.col("deleted_at") <= F.col("loaded_at"))
    stays = stays.filter(F.col("key").isNotNull() & F.col("loaded_at").isNotNull() & ~never)
    open_end = F.bool_or(F.col("deleted_at").isNull())
    return stays.groupBy("key", "loaded_at").agg(open_end.alias("_open"), F.max("deleted_at").alias("_end")).select(
        "key", "loaded_at", F.when(~F.col("_open"), F.col("_end")).alias("deleted_at")
    )


def gaps(stays: DataFrame) -> DataFrame:
    """The spans (from, to) in which a known key has no stay, and one row ``known`` per key.

    ``from`` null: before the first stay, ``to`` null: after the last.
    """
    by_key = Window.partitionBy("key").orderBy("loaded_at")
    kind = stays.schema["deleted_at"].dataType
    forever = F.lit("9999-12-31 00:00:00").cast(kind)
    never = F.lit(None).cast(kind)
    ends = stays.select("key", "loaded_at", F.coalesce("deleted_at", forever).alias("_end"))
    seen = ends.select(
        "key", "loaded_at", F.max("_end").over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.max("_end").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_until"), F.lead("loaded_at").over(by_key).alias("_next"),
    )
    gap = lambda known, start, end: F.struct(F.lit(known).alias("known"), start.alias("gap_from"), end.alias("gap_to"))
    first = F.col("_before").isNull()
    rows = F.array(
        F.when(first, gap(True, never, never)),
        F.when(first | (F.col("_before") < F.col("loaded_at")), gap(False, F.col("_before"), F.col("loaded_at"))),
        F.when(F.col("_next").isNull() & (F.col("_until") < forever), gap(False, F.col("_until"), never)),
    )
    return seen.select("key", F.explode(rows).alias("g")).filter("g IS NOT NULL").select("key", "g.known", "g.gap_from", "g.gap_to")


def find_episodes(refs: DataFrame, stays: DataFrame) -> DataFrame:
    """Every span in which a reference points nowhere, from its arrival on.

    One left join with the gaps that end after the arrival, both sides read straight from their shuffle, so
    that adaptive execution can split a key that holds a large share of the references.
    """
    g = gaps(stays).withColumnRenamed("key", "_k")
    ahead = F.col("known") | F.col("gap_to").isNull() | (F.col("gap_to") > F.col("at"))
    found = refs.join(g, (F.col("key") == F.col("_k")) & ahead, "left").filter("_k IS NULL OR NOT known")
    arrived = F.col("gap_from").isNull() | (F.col("gap_from") <= F.col("at"))
    opened = F.when(arrived, F.col("at")).otherwise(F.col("gap_from"))
    return found.select("row_id", "key", opened.alias("opened_at"), F.col("gap_to").alias("closed_at"), arrived.alias("on_arrival"))


def next_stays(stays: DataFrame, new_stays: DataFrame) -> DataFrame:
    """The parent index after a batch: a new stay takes the place of open stays with the same key and ``loaded_at``."""
    replaced = stays.join(new_stays.select("key", "loaded_at").distinct().withColumn("_new", F.lit(True)), ["key", "loaded_at"], "left")
    return replaced.filter("deleted_at IS NOT NULL OR _new IS NULL").select("key", "loaded_at", "deleted_at").unionByName(new_stays)


def next_episodes(state: OrphanState, stays: DataFrame, new_refs: DataFrame, new_stays: DataFrame) -> DataFrame:
    """The spans after a batch that leads to ``stays``: those of changed keys are found again, new references probe the index."""
    changed = new_stays.select("key").distinct()
    again = state.refs.join(changed, "key", "left_semi").select("row_id", "key", "at")
    kept = state.episodes.join(changed, "key", "left_anti").select("row_id", "key", "opened_at", "closed_at", "on_arrival")
    return kept.unionByName(find_episodes(again.unionByName(new_refs), stays))


def update(state: OrphanState, new_refs: DataFrame, new_stays: DataFrame) -> OrphanState:
    """The state after a batch."""
    stays = next_stays(state.stays, new_stays)
    return OrphanState(state.refs.unionByName(new_refs), stays, next_episodes(state, stays, new_refs, new_stays))


def update_and_cut(state: OrphanState, new_refs: DataFrame, new_stays: DataFrame) -> OrphanState:
    """``update`` with the new state written to the shared checkpoint folder, for long runs of batches."""
    after = update(state, new_refs, new_stays)
    return OrphanState(cut(after.refs), cut(after.stays), cut(after.episodes))


def episodes(tables: Buckets) -> DataFrame:
    return tables.read("episodes", EPISODES)


def advance(tables: Buckets, new_refs: DataFrame, new_stays: DataFrame) -> list[int]:
    """``update`` of the buckets that a batch has keys in; returns them. The other buckets are neither read nor written."""
    at = tables.touched(new_refs.select("key").unionByName(new_stays.select("key")), "key")
    if not at:
        return at
    before = OrphanState(tables.read("refs", REFS, at), tables.read("stays", STAYS, at), tables.read("episodes", EPISODES, at))
    tables.replace("stays", next_stays(before.stays, new_stays), at, "key")
    tables.replace("episodes", next_episodes(before, tables.read("stays", STAYS, at), new_refs, new_stays), at, "key")
    tables.append("refs", new_refs, "key")
    return at


def replay(tables: Buckets, refs: DataFrame, stays: DataFrame, starts: list[str] | None = None) -> Buckets:
    """Whole tables as the batches they arrived in, cut at ``starts`` (else: a batch a calendar year).

    A batch has the references that arrived in its period and the stays that began or ended in it; a stay
    that ends later is still open there.
    """
    stays = cut(stays)
    kind = stays.schema["deleted_at"].dataType
    bounds = years(refs, "at") if starts is None else [None, *starts, None]
    for lower, upper in zip(bounds, bounds[1:]):
        ended = F.col("deleted_at").isNotNull() & within("deleted_at", kind, lower, upper)
        changed = stays.filter(within("loaded_at", kind, None, upper) & (within("loaded_at", kind, lower, upper) | ended))
        if upper is not None:
            changed = changed.withColumn("deleted_at", F.when(within("deleted_at", kind, None, upper), F.col("deleted_at")))
        advance(tables, refs.filter(within("at", refs.schema["at"].dataType, lower, upper)), changed)
        tables.sweep()
    discard(stays)
    return tables


def on_arrival(state: OrphanState) -> DataFrame:
    """The spans of references that were orphans when they arrived."""
    return state.episodes.filter("on_arrival")


def snapshots(episodes: DataFrame, ref_table: str) -> DataFrame:
    """Per month: episodes opened, closed, and still open at its end. Months without any change are left out."""
    opened = episodes.select(F.date_trunc("month", "opened_at").alias("month"), F.lit(1).alias("o"), F.lit(0).alias("c"))
    closed = episodes.filter(F.col("closed_at").isNotNull()).select(
        F.date_trunc("month", "closed_at").alias("month"), F.lit(0).alias("o"), F.lit(1).alias("c")
    )
    monthly = opened.unionByName(closed).groupBy("month").agg(F.sum("o").alias("opened"), F.sum("c").alias("closed"))
    pending = F.sum(F.col("opened") - F.col("closed")).over(Window.partitionBy(F.lit(0)).orderBy("month"))  # a row per month
    return monthly.select(F.lit(ref_table).alias("ref_table"), "month", "opened", "closed", pending.alias("pending"))
