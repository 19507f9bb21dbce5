"""Consensus from several annotators' labels: latent ability and difficulty by gradient EM.

The chance that annotator j labels item i rightly is sigmoid(skill_j * ease_i), ease_i > 0; a wrong label
is any of the other K - 1 with equal chance. Per round, the E-step needs of each (item, label) only
the sum of its annotators' skills, so it is one aggregation with map-side combine; the M-step is one
preconditioned gradient step for all skills and eases, summed in one aggregation over label rows.
Skills have the prior N(1, 1), log ease N(0, 1 / EASE_PRECISION). Every round's parameters are written and read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import cut, discard

#: The rounds end once no skill changes by more than this (on sf0.1 no label differs from those at 0.001), or after so many.
TOLERANCE = 0.02
MOST_ROUNDS = 200
#: A few votes say little about an item's ease, so it stays near 1 unless they say much.
EASE_PRECISION = 6.0
#: Annotators and skills up to this many are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ANNOTATORS = 500_000


@dataclass
class Consensus:
    """``posteriors``: item, task, label, n_sources, posterior; ``annotators``: source, skill, reliability, n_labels.

    ``changes`` has the largest change of a skill in each round; the last one tells whether skills have settled.
    """

    votes: DataFrame
    posteriors: DataFrame
    annotators: DataFrame
    changes: list[float]


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Distinct rows with a number each, written once so that the numbers stay."""
    return cut(rows.distinct().withColumn(name, F.monotonically_increasing_id()))


def _posteriors(votes: DataFrame, skills: DataFrame, eases: DataFrame | None) -> DataFrame:
    """One row per item: ``item_no, log_ease`` and in ``p`` the posterior of each label that was given to it."""
    sums = votes.join(skills, "source").groupBy("item_no", "label_no").agg(
        F.sum("skill").alias("a"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k")
    )
    lists = sums.groupBy("item_no").agg(F.collect_list(F.struct("label_no", "a", "n")).alias("given"), F.first("k").alias("k"))  # at most K entries
    lists = lists.join(eases, "item_no", "left") if eases is not None else lists.withColumn("log_ease", F.lit(0.0))
    lists = lists.withColumn("log_ease", F.coalesce("log_ease", F.lit(0.0)))
    ease, others = F.exp("log_ease"), F.log(F.col("k") - 1.0)
    scored = lists.withColumn("_e", F.transform("given", lambda g: ease * g["a"] + g["n"] * others))
    top = scored.withColumn("_top", F.greatest(F.array_max("_e"), F.lit(0.0)))
    weights = top.withColumn("_w", F.transform("_e", lambda e: F.exp(e - F.col("_top"))))
    absent = (F.col("k") - F.size("given")) * F.exp(-F.col("_top"))  # labels of the task that nobody gave to this item
    total = F.aggregate("_w", F.lit(0.0), lambda s, w: s + w) + absent
    shares = F.zip_with("given", "_w", lambda g, w: F.struct(g["label_no"].alias("label_no"), (w / F.col("_total")).alias("p")))
    return weights.withColumn("_total", total).select("item_no", "log_ease", shares.alias("p"))


def _label_rows(state: DataFrame) -> DataFrame:
    return state.select("item_no", "log_ease", F.explode("p").alias("_p")).select("item_no", "log_ease", "_p.label_no", "_p.p")


def estimate(
    votes: DataFrame, rounds: int = MOST_ROUNDS, broadcast_limit: int = BROADCAST_ANNOTATORS, tolerance: float = TOLERANCE
) -> Consensus:
    """Estimate from distinct ``(source, task, item, label)`` rows, until skills settle or for ``rounds`` rounds; rows with a null in any of them are left out.

    Several labels of one source for one item all count. An item with one label has that label; with
    no rows at all the result is empty. Ties in the posterior are left to the reader of ``posteriors``.
    """
    columns = ("source", "task", "item", "label")
    votes = cut(votes.select(*columns).dropna().distinct())
    # the rounds move numbers only; names come back at the end
    items = _numbered(votes.select("task", "item"), "item_no")
    labels = _numbered(votes.select("task", "label"), "label_no")
    kinds = labels.groupBy("task").agg(F.greatest(F.count(F.lit(1)), F.lit(2)).cast("double").alias("k"))
    coded = cut(
        votes.join(items, ["task", "item"]).join(labels, ["task", "label"]).join(kinds, "task").select("source", "item_no", "label_no", "k")
    )
    skills = cut(coded.select("source").distinct().withColumn("skill", F.lit(1.0)))
    side = F.broadcast if skills.count() <= broadcast_limit else (lambda d: d)
    eases: DataFrame | None = None
    changes: list[float] = []
    while len(changes) < rounds and (not changes or changes[-1] > tolerance):
        now = side(skills.select("source", "skill"))
        rows = coded.join(_label_rows(_posteriors(coded, now, eases)), ["item_no", "label_no"]).join(now, "source")
        ease = F.exp("log_ease")
        right = _sigmoid(F.col("skill") * ease)
        terms = rows.select("source", "item_no", "log_ease", "skill", (F.col("p") - right).alias("_r"), (right * (1 - right)).alias("_v"), ease.alias("_ease"))
        none = F.lit(None).cast("bigint")
        for_source = F.struct(
            F.col("source").cast("bigint").alias("source"), none.alias("item_no"), F.col("skill").alias("now"),
            (F.col("_r") * F.col("_ease")).alias("g"), (F.col("_v") * F.col("_ease") * F.col("_ease")).alias("h"),
        )
        slope = F.col("skill") * F.col("_ease")
        for_item = F.struct(
            none.alias("source"), F.col("item_no"), F.col("log_ease").alias("now"), (F.col("_r") * slope).alias("g"), (F.col("_v") * slope * slope).alias("h")
        )
        both = terms.select(F.explode(F.array(for_source, for_item)).alias("t")).select("t.*")
        summed = both.groupBy("source", "item_no").agg(F.first("now").alias("now"), F.sum("g").alias("g"), F.sum("h").alias("h"))
        is_skill = F.col("source").isNotNull()
        prior, precision = F.when(is_skill, 1.0).otherwise(0.0), F.when(is_skill, 1.0).otherwise(EASE_PRECISION)
        step = (F.col("g") - (F.col("now") - prior) * precision) / (F.col("h") + precision)
        bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))
        parameters = cut(summed.select("source", "item_no", (F.col("now") + bounded).alias("value"), F.abs(bounded).alias("moved")))
        changes.append(parameters.filter("source IS NOT NULL").agg(F.max("moved").alias("m")).head().m or 0.0)
        before = skills
        skills = parameters.filter("source IS NOT NULL").select("source", F.col("value").alias("skill"))
        eases = parameters.filter("item_no IS NOT NULL").select("item_no", F.col("value").alias("log_ease"))
        skills._claimloom_path = parameters._claimloom_path
        discard(before)
    by_label = cut(_label_rows(_posteriors(coded, side(skills.select("source", "skill")), eases)))
    n_sources = coded.groupBy("item_no").agg(F.countDistinct("source").alias("n_sources"))
    named = by_label.join(n_sources, "item_no").join(items, "item_no").join(labels.select("label_no", "label"), "label_no")
    backed = coded.join(by_label, ["item_no", "label_no"]).groupBy("source")
    annotators = backed.agg(F.avg("p").alias("reliability"), F.count(F.lit(1)).alias("n_labels")).join(skills, "source")
    return Consensus(votes, named.select("task", "item", "label", "p", "n_sources", "log_ease"), annotators, changes)


def consensus_labels(result: Consensus) -> DataFrame:
    """One row per item: the label of highest posterior (ties: the smaller label), its posterior, sources and labels."""
    return result.posteriors.groupBy("task", "item").agg(
        F.min_by("label", F.struct(-F.col("p"), F.col("label"))).alias("label"),
        F.max("p").alias("posterior"),
        F.max("n_sources").alias("n_sources"),
        F.count(F.lit(1)).alias("n_labels"),
    )


def agreement(votes: DataFrame) -> DataFrame:
    """Per task: observed and expected agreement of two raters of one item, and Krippendorff's nominal alpha.

    Items with one vote take no part. ``alpha`` is null where all votes of a task are alike.
    """
    per_label = votes.groupBy("task", "item", "label").agg(F.count(F.lit(1)).alias("n"))
    per_item = Window.partitionBy("task", "item")  # at most K rows
    pairable = per_label.withColumn("m", F.sum("n").over(per_item)).filter("m > 1")
    agreed = F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1))
    labels = pairable.groupBy("task", "label").agg(F.sum("n").alias("n"), agreed.alias("agreed"))
    totals = labels.groupBy("task").agg(F.sum("n").alias("n"), F.sum("agreed").alias("agreed"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    observed = F.col("agreed") / F.col("n")
    expected = F.col("same") / (F.col("n") * (F.col("n") - 1))
    return totals.select(
        "task", F.col("n").alias("n_votes"), observed.alias("observed"), expected.alias("expected"),
        F.when(expected < 1, 1 - (1 - observed) / (1 - expected)).alias("alpha"),
    )
