"""ROC AUC, rank AUC, ROC points and enrichment factors per group.

``group`` names the columns of one evaluated list (``target`` for pooled
figures; ``target, template_id`` for one query template; a model key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.functions.bands import clean_score, shuffle_key
from shapescreen.operators.ranking import (
    average_ranks,
    banded,
    from_above,
    numbered,
    prefix_counts,
    score_histogram,
)
from shapescreen.sources.store import stage

# The fractions at which enrichment is reported.
THRESHOLDS = (0.01, 0.05)
TIE_SEED = 0
# Cut rows (list and threshold) that are sent to all tasks; beyond it they are joined by key.
_MAX_BROADCAST_CUTS = 100_000


def _below(keys: list[str], order: str) -> Column:
    window = Window.partitionBy(*keys).orderBy(order)
    return F.coalesce(F.sum("neg").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    crossing = F.col("pairs") + F.col("pos").cast("double") * F.col("below")
    return parts.groupBy(*keys).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(crossing).alias("pairs")
    )


def auc_of_bands(bands: DataFrame, group: list[str], name: str) -> DataFrame:
    """From rows ``(*group, band, pos, neg, pairs)``, ``pairs`` being those within a band."""
    totals = _combined(bands.withColumn("below", _below(group, "band")), group)
    all_pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    return totals.select(*group, F.try_divide("pairs", all_pairs).alias(name))


def _auc_of_histogram(hist: DataFrame, group: list[str], name: str) -> DataFrame:
    """Count ordered (negative, positive) pairs band by band, ties counting one half.

    A band needs only its positives, its negatives and its inner pairs to be
    combined with the bands below it.  Pairs are counted within fine bands, over
    the fine bands of a band, and over the bands of a group, so that no task sees
    a whole group, however many scores it pools.
    """

    scores = hist.select(
        *group,
        "band",
        "fine",
        "score",
        "pos",
        (F.col("n") - F.col("pos")).alias("neg"),
    ).withColumn("pairs", F.col("pos") * F.col("neg") / F.lit(2.0))
    fine = _combined(
        scores.withColumn("below", _below([*group, "band", "fine"], "score")), [*group, "band", "fine"]
    )
    bands = _combined(fine.withColumn("below", _below([*group, "band"], "fine")), [*group, "band"])
    return auc_of_bands(bands, group, name)


def counts(scores: DataFrame, group: list[str]) -> DataFrame:
    """Distinct scores of each list with running counts: the base of every measure."""
    return prefix_counts(score_histogram(scores, group), group)


def roc_auc(scores: DataFrame, group: list[str], name: str = "auc") -> DataFrame:
    """Area under the ROC curve; NULL when a group has only one class."""
    return _auc_of_histogram(score_histogram(scores, group), group, name)


def rank_auc(
    scores: DataFrame, group: list[str], template: str = "template_id", name: str = "auc_rank"
) -> DataFrame:
    """Pooled AUC after replacing each score by its mean rank within its template."""
    return _rank_auc(counts(scores, [*group, template]), group, template, name)


def _rank_auc(counted: DataFrame, group: list[str], template: str, name: str) -> DataFrame:
    ranks = average_ranks(counted, [*group, template])
    return rank_auc_of_counts(ranks.select(*group, F.col("avg_rank").alias("score"), "n", "pos"), group, name)


def rank_auc_of_counts(ranks: DataFrame, group: list[str], name: str = "auc_rank") -> DataFrame:
    """The same from rows ``(*group, score, n, pos)`` with mean ranks as scores; a rank may have several."""
    pooled = ranks.groupBy(*group, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return _auc_of_histogram(banded(pooled, group), group, name)


def roc_points(scores: DataFrame, group: list[str]) -> DataFrame:
    """One point per distinct score from the best down, after the origin (NULL threshold)."""
    counted = from_above(counts(scores, group))
    neg_total = F.col("n_total") - F.col("pos_total")
    true_pos = F.col("pos_before") + F.col("pos")
    seen = F.col("n_before") + F.col("n")
    point = F.struct(
        F.try_divide((seen - true_pos).cast("double"), neg_total.cast("double")).alias("fpr"),
        F.try_divide(true_pos.cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    origin = F.struct(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    points = F.when(F.col("n_before") == 0, F.array(origin, point)).otherwise(F.array(point))
    return counted.select(*group, F.explode(points).alias("p")).select(
        *group, "p.fpr", "p.tpr", "p.threshold"
    )


def enrichment(
    scores: DataFrame,
    group: list[str],
    thresholds=THRESHOLDS,
    eval_method: str = "sim",
    identifier: str = "mol_id",
) -> DataFrame:
    """Enrichment factor of each group at each threshold.

    ``eval_method`` "sim" ranks high scores first, anything else low scores.
    An expectation of 0 gives infinity; ``top_n`` tells such groups apart.
    """
    return _enrichment(
        counts(scores, group), scores, group, thresholds, eval_method, identifier
    )


def _enrichment(counted, scores, group, thresholds, eval_method, identifier) -> DataFrame:
    """Find the cut of each list in its counts.

    Only where the cut falls inside a tie of both classes are rows looked up
    again, in a seeded random order that favours no label.  Cuts are few (lists
    times thresholds) and stored, so this second look is planned only if needed.
    """
    if eval_method == "sim":
        counted = from_above(counted)
    wanted = F.transform(
        F.array(*[F.lit(float(t)) for t in thresholds]),
        lambda t: F.struct(
            t.alias("threshold"), F.floor(t * F.col("n_total")).cast("bigint").alias("top_n")
        ),
    )
    is_cut = lambda t: F.when(t["top_n"] == 0, F.col("n_before") == 0).otherwise(
        (F.col("n_before") < t["top_n"]) & (t["top_n"] <= F.col("n_before") + F.col("n"))
    )
    need = F.col("top_n") - F.col("n_before")
    tied_hits = (
        F.when((F.col("pos") == 0) | (need == 0), F.lit(0).cast("bigint"))
        .when(F.col("pos") == F.col("n"), need)
        .when(need == F.col("n"), F.col("pos"))
    )
    cuts = stage(
        counted.withColumn("t", F.explode(F.filter(wanted, is_cut)))
        .select("*", "t.threshold", "t.top_n")
        .drop("t")
        .select(
            *group,
            "threshold",
            "top_n",
            "score",
            "n_total",
            "pos_total",
            "pos_before",
            need.alias("need"),
            tied_hits.cast("bigint").alias("tied_hits"),
        ),
        "cuts",
    )
    mixed = cuts.filter(F.col("tied_hits").isNull())
    n_mixed = mixed.count()
    if n_mixed:
        few = n_mixed <= _MAX_BROADCAST_CUTS
        cuts = cuts.filter(F.col("tied_hits").isNotNull()).unionByName(
            _mixed_tie_hits(scores, mixed.drop("tied_hits"), group, identifier, few)
        )
    hits = F.col("pos_before") + F.col("tied_hits")
    expected = F.col("pos_total").cast("double") / F.col("n_total") * F.col("top_n")
    return cuts.select(
        *group,
        "threshold",
        "top_n",
        F.when(expected > 0, F.try_divide(hits.cast("double"), expected))
        .otherwise(F.lit(float("inf")))
        .alias("ef"),
    )


def _mixed_tie_hits(
    scores: DataFrame, cuts: DataFrame, group: list[str], identifier: str, few: bool
) -> DataFrame:
    """Positives among the first ``need`` rows of a tie, in seeded random order.

    One tie may span a large part of the table.  A few cuts are sent to the
    rows; more are joined on the cut and two hex digits of the random key.  The
    numbering works on four digits.
    """
    rows = scores.select(
        *group,
        clean_score(F.col("score")).alias("score"),
        F.col("truth").cast("bigint").alias("truth"),
        shuffle_key(F.col(identifier), TIE_SEED).alias("key"),
    )
    if few:
        tied = rows.join(F.broadcast(cuts), [*group, "score"])
    else:
        salts = F.array(*[F.lit(f"{i:02x}") for i in range(256)])
        salted = cuts.withColumn("salt", F.explode(salts)).hint("merge")
        tied = rows.withColumn("salt", F.substring("key", 1, 2)).join(
            salted, [*group, "score", "salt"]
        )
    tied = tied.withColumn("cell", F.substring("key", 1, 4))
    lists = [*group, "threshold"]
    first = numbered(tied, lists, "cell", ["key"]).filter(F.col("rn") <= F.col("need"))
    carried = [c for c in cuts.columns if c not in lists]
    return (
        first.groupBy(*lists)
        .agg(*[F.first(c).alias(c) for c in carried], F.sum("truth").alias("tied_hits"))
        .select(*cuts.columns, "tied_hits")
    )


def mean_enrichment(
    scores: DataFrame,
    group: list[str],
    template: str = "template_id",
    thresholds=THRESHOLDS,
    eval_method: str = "sim",
    identifier: str = "mol_id",
) -> DataFrame:
    """Average over the templates of a group of their enrichment factors."""
    per_template = enrichment(scores, [*group, template], thresholds, eval_method, identifier)
    return per_template.groupBy(*group, "threshold").agg(F.avg("ef").alias("mean_ef"))


def evaluate(
    scores: DataFrame,
    group: list[str],
    template: str | None = None,
    eval_method: str = "sim",
    identifier: str = "mol_id",
) -> DataFrame:
    """One row per group: ``auc``, ``auc_rank``, ``ef_1``, ``ef_5``.

    Scores are read once: their counts are stored and every measure is taken
    from them.
    """
    lists = group if template is None else [*group, template]
    counted = stage(counts(scores, lists), "counts")
    pooled = counted
    if template is None:
        counted = counted.withColumn("_list", F.lit(0))
    else:
        pooled = counted.groupBy(*group, "band", "fine", "score").agg(
            F.sum("n").alias("n"), F.sum("pos").alias("pos")
        )
    per_list = _enrichment(counted, scores, lists, THRESHOLDS, eval_method, identifier)
    efs = per_list.groupBy(*group).agg(
        F.avg(F.when(F.col("threshold") == THRESHOLDS[0], F.col("ef"))).alias("ef_1"),
        F.avg(F.when(F.col("threshold") == THRESHOLDS[1], F.col("ef"))).alias("ef_5"),
    )
    return (
        _auc_of_histogram(pooled, group, "auc")
        .join(_rank_auc(counted, group, template or "_list", "auc_rank"), group)
        .join(efs, group)
        .select(*group, "auc", "auc_rank", "ef_1", "ef_5")
    )
