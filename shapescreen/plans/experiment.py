"""Screening reports and model experiments.

Targets, portions, parameters and folds are columns.  All models of an
experiment are trained together and all their score lists evaluated together.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapescreen.operators import gmm, iforest, mlp, ocsvm, sampling
from shapescreen.operators.evaluation import evaluate
from shapescreen.operators.lists import ScreenLists
from shapescreen.operators.models import training_rows
from shapescreen.operators.molecules import union_frames
from shapescreen.operators.screening import screen
from shapescreen.sources.descriptors import DESCRIPTOR_TYPES
from shapescreen.sources.store import RunLog, stage

METRICS = ("auc", "auc_rank", "ef_1", "ef_5")


@dataclass
class Family:
    """A kind of model: how to fit and score it, its grid and how its parameter is chosen."""

    fit: Callable
    score: Callable
    params: tuple
    folds: int
    metric: str
    actives_only: bool = True
    options: dict = field(default_factory=dict)
    # Options of the final fit, where they differ.
    final: dict = field(default_factory=dict)


# Grids, fold counts and the metric that picks the parameter.
FAMILIES = {
    "gmm": Family(gmm.fit, gmm.score, gmm.COMPONENTS, 5, "ef_1"),
    "gmm_auc": Family(gmm.fit, gmm.score, gmm.COMPONENTS, 10, "auc"),
    "iforest": Family(iforest.fit, iforest.score, iforest.TREES, 5, "ef_1"),
    "ocsvm": Family(ocsvm.fit, ocsvm.score, (ocsvm.NU_PERCENT,), 3, "auc"),
    "mlp": Family(mlp.fit, mlp.score, mlp.HIDDEN, 3, "auc", False, final={"max_iter": 500}),
    "mlp_early_stopping": Family(
        mlp.fit, mlp.score, mlp.HIDDEN, 3, "auc", False, {"max_iter": 1000, "early_stopping": True}
    ),
    "mlp_activity": Family(
        mlp.fit,
        mlp.score,
        mlp.HIDDEN,
        5,
        "auc_rank",
        False,
        {"max_iter": 1000, "tol": 1e-3, "alpha": 0.0, "activity_l2": mlp.ACTIVITY_L2},
    ),
}


def screening_report(molecules: DataFrame, template_conformers: str = "all") -> DataFrame:
    """Rank all molecules against every active; one row of figures per target and descriptor type."""
    keys = [c for c in ("target", "dtype") if c in molecules.columns]
    return ScreenLists(molecules, template_conformers, keys=tuple(keys)).figures()


def screening_results(
    molecules: DataFrame,
    portions=(1.0,),
    template_conformers: str = "lec",
    seed: int = 0,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Screening figures per target, descriptor type and portion, all types in one run.

    ``elapsed_s`` is the wall time of the run.
    """
    began = time.time()
    if tuple(portions) == (1.0,):
        sampled = molecules.withColumn("portion", F.lit(1.0))
    else:
        sampled = _sampled(molecules, portions, "SEQUENTIAL", seed, totals)
    lists = ScreenLists(sampled, template_conformers, keys=("target", "dtype", "portion"))
    figures = stage(lists.figures(), "screening")
    return figures.withColumn("elapsed_s", F.lit(time.time() - began))


def screening_portions(
    molecules: DataFrame,
    portions=sampling.PORTIONS[1:],
    template_conformers: str = "lec",
    policy: str = "SEQUENTIAL",
    seed: int = 0,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Scores of samples of each target at several portions, at its label ratio.

    The same molecules are taken for every descriptor type.  ``totals``: see :func:`sampling.draw`.
    """
    sampled = _sampled(molecules, portions, policy, seed, totals)
    return screen(sampled, template_conformers, keys=("target", "dtype", "portion"))


def _sampled(molecules: DataFrame, portions, policy: str, seed: int, totals: DataFrame | None) -> DataFrame:
    keys = molecules.select("target", "mol_id", "active").distinct()
    drawn = sampling.draw(keys, portions, 1.0, -1, policy, seed, totals=totals)
    return stage(drawn.drop("active").join(molecules, ["target", "mol_id"]), "portions")


@dataclass
class Split:
    """Molecules of an experiment, stored once, each with its ``roles``: the parts it belongs to, with
    ``portion`` and ``fold`` (-1: none).  A part is a predicate over them, not a copy."""

    molecules: DataFrame

    def part(self, name: str) -> DataFrame:
        """``target, mol_id, active, conformers, portion, fold`` of one part."""
        own = F.explode(F.filter("roles", lambda r: r["part"] == name)).alias("role")
        return self.molecules.select("target", "mol_id", "active", "conformers", own).select(
            "target", "mol_id", "active", "role.portion", "role.fold", "conformers"
        )

    @property
    def test(self) -> DataFrame:
        return self.part("test")

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def cross(self) -> DataFrame:
        return self.part("cross")

    @property
    def redraw(self) -> DataFrame:
        return self.part("redraw")


def split(
    molecules: DataFrame,
    portions=sampling.PORTIONS,
    folds: int = 5,
    seed: int = 0,
    totals: DataFrame | None = None,
) -> Split:
    """Hold-out split, folds of the training part, and the redrawn training actives.

    ``molecules`` are of one descriptor type; :func:`run_types` takes several.  ``totals``: see
    :func:`sampling.draw`.  Only keys are drawn and numbered; descriptors move once.
    """
    keys = stage(molecules.select("target", "mol_id", "active"), "keys")
    draw = lambda share, seed, **kw: sampling.draw(keys, portions, share, -1, "RANDOM", seed, totals=totals, **kw)
    test_keys = stage(draw(sampling.TEST_SHARE, seed), "test")
    train_keys = stage(draw(sampling.TRAIN_SHARE, seed + 1, exclude=test_keys), "train")
    folded = sampling.kfold(train_keys, folds, ["target", "portion"], "RANDOM", seed + 3)
    again = sampling.training_redraw(keys, test_keys, portions, seed, totals=totals)
    drawn = {"test": test_keys, "train": train_keys, "cross": folded, "redraw": again}

    def role(rows: DataFrame, name: str) -> DataFrame:
        fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-1)
        portion = F.col("portion").cast("double")
        return rows.select(
            "target", "mol_id", F.struct(F.lit(name).alias("part"), portion.alias("portion"), fold.alias("fold")).alias("role")
        )

    # At most one role for each part and portion.
    roles = union_frames(*(role(rows, name) for name, rows in drawn.items())).groupBy("target", "mol_id")
    members = stage(roles.agg(F.sort_array(F.collect_list("role")).alias("roles")), "roles")
    body = molecules.select("target", "mol_id", "active", "conformers")
    return Split(stage(body.join(members, ["target", "mol_id"]), "split-molecules"))


def cross_validate(
    data: Split, family: Family, params=None, folds: int | None = None, train_mode: str = "all", **options
) -> DataFrame:
    """Figures of each model on its held-out fold; models that were skipped have NULL figures."""
    params = family.params if params is None else params
    folds = family.folds if folds is None else folds
    rows = training_rows(data.cross, family.actives_only, train_mode)
    models = family.fit(rows, params, range(folds), **{**family.options, **options})
    key = ["target", "portion", "param", "fold"]
    scores = stage(family.score(data.cross, models), "fold-scores")
    figures = evaluate(scores, key)
    return models.select(*key, "n_rows", "status").join(figures, key, "left")


def xval_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over folds, per target, portion and parameter."""
    over = [f(m).alias(f"{n}_{m}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    summary = folds.groupBy("target", "portion", "param").agg(F.count("auc").alias("folds"), *over)
    return summary.withColumn("status", F.when(F.col("folds") > 0, "ok").otherwise("skipped"))


def best_param(summary: DataFrame, metric: str, params) -> DataFrame:
    """Parameter with the best mean figure; the earlier one in the grid wins a tie."""
    place = F.array_position(F.array(*[F.lit(int(p)) for p in params]), F.col("param").cast("int"))
    order = Window.partitionBy("target", "portion").orderBy(
        F.desc(F.coalesce(f"mean_{metric}", F.lit(0.0))), place
    )
    return (
        summary.withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
        .select("target", "portion", F.col("param").alias("best_param"))
    )


def _chosen(best: DataFrame) -> dict:
    """The chosen parameter per (target, portion): one small row each."""
    return {(r["target"], float(r["portion"])): int(r["best_param"]) for r in best.collect()}


def final_evaluation(
    data: Split, family: Family, best: DataFrame, train_mode: str = "all", **options
) -> DataFrame:
    """Train with the chosen parameter on the training part, report on the test part.

    Families that learn from actives only use the redrawn actives.  ``elapsed_s``
    is the wall time of the whole run, as all models are trained together.
    """
    began = time.time()
    source = data.redraw if family.actives_only else data.train
    chosen = _chosen(best)
    models = family.fit(
        training_rows(source, family.actives_only, train_mode),
        family.params,
        (-1,),
        chosen=chosen,
        **{**family.options, **family.final, **options},
    )
    scores = stage(family.score(data.test, models), "test-scores")
    figures = stage(evaluate(scores, ["target", "portion"]), "test-figures")
    status = models.select("target", "portion", F.col("param").alias("best_param"), "status")
    return status.join(figures, ["target", "portion"], "left").withColumn(
        "elapsed_s", F.lit(time.time() - began)
    )


def refit(
    data: Split, family: Family, best: DataFrame, train_mode: str = "all", actives_only: bool | None = None, **options
) -> DataFrame:
    """Train on test and training molecules together with the chosen parameter; the models to keep."""
    only = family.actives_only if actives_only is None else actives_only
    everything = data.test.unionByName(data.train)
    return family.fit(
        training_rows(everything, only, train_mode),
        family.params,
        (-1,),
        chosen=_chosen(best),
        **{**family.options, **family.final, **options},
    )


@dataclass
class Experiment:
    xval: DataFrame
    best: DataFrame
    final: DataFrame
    models: DataFrame


def run(
    molecules: DataFrame,
    family: Family,
    portions=sampling.PORTIONS,
    params=None,
    folds: int | None = None,
    metric: str | None = None,
    train_mode: str = "all",
    seed: int = 0,
    totals: DataFrame | None = None,
    **options,
) -> Experiment:
    """Whole experiment: split, cross-validate, choose, evaluate on the test part, refit."""
    params = family.params if params is None else params
    folds = family.folds if folds is None else folds
    data = split(molecules, portions, folds, seed, totals)
    summary = stage(
        xval_summary(cross_validate(data, family, params, folds, train_mode, **options)), "xval"
    )
    best = stage(best_param(summary, metric or family.metric, params), "best")
    final = final_evaluation(data, family, best, train_mode, **options)
    return Experiment(summary, best, final, refit(data, family, best, train_mode, **options))


def run_types(molecules: DataFrame, family: Family, dtypes=DESCRIPTOR_TYPES, **options) -> Experiment:
    """The experiment for each descriptor type of one table; every result has its ``dtype``."""
    parts = [
        (name, run(molecules.filter(F.col("dtype") == name), family, **options))
        for name in dtypes
    ]
    return Experiment(
        *(
            union_frames(*(getattr(part, field).withColumn("dtype", F.lit(name)) for name, part in parts))
            for field in ("xval", "best", "final", "models")
        )
    )


def resume(molecules: DataFrame, family: Family, folder: str, **options) -> RunLog:
    """Run the experiment for the targets that no run has finished yet; results and models of a target
    appear together (:class:`RunLog`).  A run that stops before its commit is repeated."""
    log = RunLog(molecules.sparkSession, folder)
    todo = stage(log.pending(molecules), "pending-targets")
    if not todo.isEmpty():
        name = log.start()
        made = run(stage(molecules.join(todo, "target", "left_semi"), "pending-molecules"), family, **options)
        log.write("results", name, made.final)
        log.write("models", name, made.models)
        log.commit(name, todo)
    return log
