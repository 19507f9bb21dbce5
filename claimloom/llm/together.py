"""Items that appear together: pair and marginal counts kept incrementally in bucketed tables.

The state (``Buckets``) is kept by hash of key: ``edges`` (basket, item), ``baskets`` (basket, n), ``items``
(item, n, mask), ``pairs`` (item_a < item_b, n: signed counts, summed on reading) and ``scores`` (the pairs in
at least ``min_support`` baskets). A batch of added and removed rows is first reduced to the memberships that
really change. Those emit signed deltas of basket sizes, of item counts and of pairs: a changed membership
meets the other items of its basket only, so a basket of n items with c changes costs c * n rows. Pair deltas
are added up before the shuffle. Those of a batch that is small beside the state are appended to their buckets
(a bucket of many pieces is merged), those of a large one are merged with the counts at once, in the same shuffle.
Sizes and counts are rewritten in the buckets concerned; scores are found again for pairs with an item of a changed
membership, and the buckets without such pairs stay.

Two exact reductions keep the pair table small. A pair seen ``min_support`` times has both items in at
least that many baskets, so only such (frequent) items form pairs. And it occurs at least once outside
any ``min_support - 1`` baskets, so the largest few baskets (at most that many, of more than ``heavy``
items) never form pairs; each item carries a bit mask of the heavy baskets that hold it, and
their share of a pair's count is the common bits. A basket that holds a third of all rows costs no pair.
An item that becomes or ceases to be frequent, or a basket that becomes or ceases to be heavy, changes
its memberships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.buckets import MERGE_AFTER, Buckets, within, years
from claimloom.session import cut, discard

HEAVY = 1000
#: A batch that changes at least this share of all memberships is large.
LARGE = 0.25
#: A mask has a bit per heavy basket; fewer heavy baskets than could be spared are as exact.
SLOTS = 63


def state(spark: SparkSession, min_support: int, heavy: int = HEAVY, tables: Buckets | None = None) -> Buckets:
    """Empty state: baskets of more than ``heavy`` items may be spared. ``tables``: where to keep it, else a folder of its own."""
    tables = tables or Buckets.scratch(spark)
    tables.values = {"min_support": min_support, "heavy": heavy, "slots": [], "n_baskets": 0, "n_edges": 0}
    return tables


def _changes(tables: Buckets, added: DataFrame, removed: DataFrame, types: str) -> tuple[DataFrame, list[int]]:
    """The memberships that change: ``basket, item, d`` (1 or -1), and the buckets of the baskets they are in."""
    plus = added.select("basket", "item", F.lit(0).alias("o"), F.lit(1).alias("p"), F.lit(0).alias("m"))
    minus = removed.select("basket", "item", F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit(1).alias("m"))
    asked = plus.unionByName(minus).dropna(subset=["basket", "item"])
    old = tables.read("edges", types)
    if "edges" in tables.tables:
        old = tables.read("edges", types, tables.touched(asked, "basket"))
    old = old.join(asked.select("basket").distinct(), "basket", "left_semi").select("basket", "item", F.lit(1).alias("o"), F.lit(0).alias("p"), F.lit(0).alias("m"))
    seen = old.unionByName(asked).groupBy("basket", "item").agg(*[F.max(c).alias(c) for c in "opm"])
    now = F.greatest(F.col("p"), F.col("o") * (1 - F.col("m")))
    delta = cut(seen.select("basket", "item", (now - F.col("o")).alias("d")).filter("d <> 0"))
    return delta, tables.touched(delta, "basket")


def _resize(tables: Buckets, delta: DataFrame, at: list[int], basket: str) -> tuple[dict, dict]:
    """New basket sizes; the heavy baskets with their slots before and after (at most ``min_support - 1`` rows reach the driver)."""
    sizes = tables.read("baskets", f"basket {basket}, n bigint", at)
    moved = delta.groupBy("basket").agg(F.sum("d").alias("n"))
    merged = sizes.unionByName(moved).groupBy("basket").agg(F.sum("n").alias("n")).filter("n > 0")
    tables.replace("baskets", merged, at, "basket", spread=False)
    now = tables.read("baskets", f"basket {basket}, n bigint")
    most = min(tables.values["min_support"] - 1, SLOTS)
    big = [r.basket for r in now.filter(F.col("n") > tables.values["heavy"]).orderBy(F.desc("n"), "basket").limit(most).collect()]
    before = {b: s for b, s in tables.values["slots"]}
    after = {b: s for b, s in before.items() if b in big}
    free = [s for s in range(SLOTS) if s not in after.values()]
    for b in big:
        if b not in after:
            after[b] = free.pop(0)
    tables.values["slots"], tables.values["n_baskets"] = [[b, s] for b, s in after.items()], now.count()
    return before, after


def _bits(slots: dict):
    """The mask bit of a row's basket, 0 for a light one."""
    bit = F.lit(0).cast("bigint")
    for basket, slot in slots.items():
        bit = F.when(F.col("basket") == F.lit(basket), F.lit(1 << slot).cast("bigint")).otherwise(bit)
    return bit


def _recount(tables: Buckets, delta: DataFrame, edges: DataFrame, before: dict, after: dict, item: str) -> DataFrame:
    """New item counts and masks; ``item, n_was, n, moved`` of the items in the buckets concerned."""
    none = F.lit(0).cast("bigint")
    stayed = {b: s for b, s in before.items() if b in after}
    bit = _bits(stayed)
    gone, come = F.when(F.col("d") < 0, bit).otherwise(none), F.when(F.col("d") > 0, bit).otherwise(none)
    change = delta.select("item", F.col("d").cast("bigint").alias("d"), gone.alias("clear"), come.alias("put"))
    ceased, began = {b: s for b, s in before.items() if b not in after}, {b: s for b, s in after.items() if b not in before}
    if ceased:  # what it holds now and what it lost
        held = edges.select("basket", "item").unionByName(delta.select("basket", "item")).filter(F.col("basket").isin(*ceased))
        change = change.unionByName(held.select("item", none.alias("d"), _bits(ceased).alias("clear"), none.alias("put")))
    if began:
        change = change.unionByName(edges.filter(F.col("basket").isin(*began)).select("item", none.alias("d"), none.alias("clear"), _bits(began).alias("put")))
    change = cut(change.groupBy("item").agg(F.sum("d").alias("d"), F.bit_or("clear").alias("clear"), F.bit_or("put").alias("put")))
    at = tables.touched(change, "item")
    old = tables.read("items", f"item {item}, n bigint, mask bigint", at)
    both = old.select("item", "n", "mask", none.alias("d"), none.alias("clear"), none.alias("put"), F.lit(False).alias("moved")).unionByName(
        change.select("item", none.alias("n"), none.alias("mask"), "d", "clear", "put", F.lit(True).alias("moved"))  # also where the changes add up to 0
    )
    summed = both.groupBy("item").agg(*[F.sum(c).alias(c) for c in "nd"], *[F.bit_or(c).alias(c) for c in ("mask", "clear", "put")], F.bool_or("moved").alias("moved"))
    mask = F.col("mask").bitwiseAND(F.bitwise_not("clear")).bitwiseOR(F.col("put"))
    merged = cut(summed.select("item", F.col("n").alias("n_was"), (F.col("n") + F.col("d")).alias("n"), mask.alias("mask"), "moved"))
    tables.replace("items", merged.filter("n > 0").select("item", "n", "mask"), at, "item", spread=False)
    discard(change)
    return merged


def _concerned(delta: DataFrame, edges: DataFrame, flipped: DataFrame, turned: list) -> DataFrame:
    """The edges of the baskets in which a membership, the frequency of an item or the weight of the basket changed."""
    baskets = delta.select("basket").unionByName(edges.join(flipped, "item", "left_semi").select("basket"))
    if turned:
        baskets = baskets.unionByName(edges.filter(F.col("basket").isin(*turned)).select("basket"))
    return edges.join(baskets.distinct(), "basket", "left_semi")


def _pair_deltas(
    tables: Buckets, delta: DataFrame, edges: DataFrame, moved: DataFrame, before: dict, after: dict, item: str, large: bool
) -> tuple[DataFrame, DataFrame]:
    """``item_a < item_b, n``, not yet added up: what the batch changes in the number of light baskets that hold both, as
    frequent items; and the memberships it is made from, to be discarded afterwards."""
    m = tables.values["min_support"]
    flipped = moved.filter((F.col("n_was") >= m) != (F.col("n") >= m)).select("item", (F.col("n_was") >= m).alias("was_f"), (F.col("n") >= m).alias("now_f"))
    steady = tables.read("items", f"item {item}, n bigint, mask bigint").filter(F.col("n") >= m).join(flipped, "item", "left_anti")
    frequent = steady.select("item", F.lit(True).alias("was_f"), F.lit(True).alias("now_f")).unionByName(flipped)
    rows = edges if large else _concerned(delta, edges, flipped, sorted(set(before) ^ set(after)))
    rows = rows.select("basket", "item", F.lit(1).alias("now"), F.lit(0).alias("d"))
    rows = rows.unionByName(delta.select("basket", "item", F.lit(0).alias("now"), "d")).groupBy("basket", "item").agg(F.max("now").alias("now"), F.sum("d").alias("d"))
    light = lambda slots: ~F.col("basket").isin(*slots) if slots else F.lit(True)
    was = (F.col("now") - F.col("d") == 1) & F.col("was_f") & light(before)
    now = (F.col("now") == 1) & F.col("now_f") & light(after)
    active = rows.join(frequent, "item").select("basket", "item", was.alias("was"), now.alias("now")).filter("was OR now")
    active = cut(active)
    left = active.filter("was <> now").select("basket", F.col("item").alias("x"), F.col("was").alias("was_x"), F.col("now").alias("now_x"))
    right = active.select("basket", F.col("item").alias("y"), F.col("was").alias("was_y"), F.col("now").alias("now_y"))
    met = left.join(right, "basket").filter("x <> y AND (was_y = now_y OR x < y)")  # two changed items meet once
    step = (F.col("now_x") & F.col("now_y")).cast("int") - (F.col("was_x") & F.col("was_y")).cast("int")
    signed = met.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), step.cast("bigint").alias("n")).filter("n <> 0")
    return signed, active


def _added_up(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item_a", "item_b").agg(F.sum("n").alias("n")).filter("n <> 0")


def _rescore(tables: Buckets, moved: DataFrame, item: str, first: bool, large: bool) -> None:
    """Scores of the pairs with an item of a changed membership; the others stay as they are."""
    m = tables.values["min_support"]
    kind = f"item_a {item}, item_b {item}, n_ab bigint, n_a bigint, n_b bigint"
    changed = moved.filter("moved").select("item")

    def about(rows: DataFrame, wanted: bool) -> DataFrame:
        a, b = (changed.select(F.col("item").alias(f"item_{s}"), F.lit(True).alias(f"_{s}")) for s in "ab")
        flagged = rows.join(a, "item_a", "left").join(b, "item_b", "left")
        any_ = F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))
        return flagged.filter(any_ if wanted else ~any_).select(*rows.columns)

    counts = tables.read("pairs", f"item_a {item}, item_b {item}, n bigint")
    counts = counts if large else about(counts, True)
    if max(tables.pieces("pairs").values(), default=1) > 1:
        counts = _added_up(counts)
    near = counts.filter(F.col("n") >= m - len(tables.values["slots"]))
    near = about(near, True) if large and not first else near
    items = tables.read("items", f"item {item}, n bigint, mask bigint").filter(F.col("n") >= m)
    side = lambda s: items.select(F.col("item").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"), F.col("mask").alias(f"mask_{s}"))
    n_ab = F.col("n") + F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b")))
    scored = near.join(side("a"), "item_a").join(side("b"), "item_b").select("item_a", "item_b", n_ab.alias("n_ab"), "n_a", "n_b").filter(F.col("n_ab") >= m)
    if first:
        tables.append("scores", scored, "item_a", "item_b")
        return
    scored = cut(scored)
    old = tables.read("scores", kind)
    at = tables.touched(about(old, True).select("item_a", "item_b").unionByName(scored.select("item_a", "item_b")), "item_a", "item_b")
    if at:
        tables.replace("scores", about(tables.read("scores", kind, at), False).unionByName(scored), at, "item_a", "item_b")
    discard(scored)


def update(tables: Buckets, added: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
    """A batch of added and removed ``basket, item`` rows; how many buckets of each table it wrote.

    Adding what is there and removing what is not change nothing; an item both added and removed in one
    batch is there afterwards. Nulls and repeats are left out.
    """
    removed = added.limit(0) if removed is None else removed
    basket, item = (added.schema[c].dataType.simpleString() for c in ("basket", "item"))
    types = f"basket {basket}, item {item}"
    first = "edges" not in tables.tables
    delta, at = _changes(tables, added, removed, types)
    sizes = delta.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d")).head()
    tables.values["n_edges"] += sizes.d
    large = sizes.n >= LARGE * tables.values["n_edges"]
    wrote = {"edges": len(at), "baskets": len(at)}
    if not at:
        discard(delta)
        return wrote
    tables.append("edges", delta.filter("d > 0").select("basket", "item"), "basket", spread=True)
    gone = delta.filter("d < 0")
    emptied = tables.touched(gone, "basket")
    if emptied:
        left = tables.read("edges", types, emptied).join(gone, ["basket", "item"], "left_anti")
        tables.replace("edges", left, emptied, "basket")
    before, after = _resize(tables, delta, at, basket)
    edges = tables.read("edges", types)
    moved = _recount(tables, delta, edges, before, after, item)
    signed, active = _pair_deltas(tables, delta, edges, moved, before, after, item, large)
    if large:
        merged = _added_up(tables.read("pairs", f"item_a {item}, item_b {item}, n bigint").unionByName(signed))
        tables.replace("pairs", merged, list(range(tables.n)), "item_a", "item_b", spread=False)
        wrote["pairs"] = tables.n
    else:
        wrote["pairs"] = len(tables.append("pairs", _added_up(signed), "item_a", "item_b", spread=False))
        many = [b for b, n in tables.pieces("pairs").items() if n > MERGE_AFTER]
        if many:
            tables.replace("pairs", _added_up(tables.read("pairs", "", many)), many, "item_a", "item_b", spread=False)
    discard(active)
    _rescore(tables, moved, item, first, large)
    discard(delta)
    discard(moved)
    return wrote


def replay(tables: Buckets, rows: DataFrame, time: str, starts: list[str] | None = None) -> Buckets:
    """A whole table ``basket, item`` as the batches it arrived in by ``time``, cut at ``starts`` (else: a batch a calendar year)."""
    bounds = years(rows, time) if starts is None else [None, *starts, None]
    for lower, upper in zip(bounds, bounds[1:]):
        update(tables, rows.filter(within(time, rows.schema[time].dataType, lower, upper)).select("basket", "item"))
        tables.sweep()
    return tables


def associations(tables: Buckets, item: str = "bigint") -> DataFrame:
    """Every pair in at least ``min_support`` baskets: ``item_a, item_b, n_ab, n_a, n_b, n_baskets, lift``.

    ``lift`` is how many times as often as by chance the two occur together.
    """
    scores = tables.read("scores", f"item_a {item}, item_b {item}, n_ab bigint, n_a bigint, n_b bigint")
    scored = scores.withColumn("n_baskets", F.lit(tables.values["n_baskets"]).cast("bigint"))
    return scored.withColumn("lift", F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b")).cast("double"))
