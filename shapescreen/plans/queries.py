"""Registered queries: each runs one operator or plan over whole tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapescreen.functions import gaussians
from shapescreen.operators import evaluation, facts, gmm, iforest, mlp, nearest, ocsvm, sampling
from shapescreen.operators import molecules as mols
from shapescreen.operators.lists import ScreenLists
from shapescreen.operators.models import as_dataset, training_rows
from shapescreen.operators.screening import screen
from shapescreen.plans import experiment
from shapescreen.plans.experiment import FAMILIES
from shapescreen.session import ship_package
from shapescreen.sources import descriptors, embeddings
from shapescreen.sources.store import RunLog, pending_targets, stage, stage_folder

SCORE_KEYS = ("target", "template_id", "mol_id", "score", "truth")
# Molecules scored per similarity in the stand-in data: parameters of the deterministic models.
FEATURE_PARAMS = (1, 2, 3)


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.molecules(spark, sf).select("target", "mol_id", "active")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _scores(spark: SparkSession, sf: str, template_conformers: str = "all") -> DataFrame:
    return _rounded(screen(embeddings.molecules(spark, sf), template_conformers), 9, "score")


def _lists(spark: SparkSession, sf: str) -> ScreenLists:
    return ScreenLists(embeddings.molecules(spark, sf), digits=9)


# ---- molecules -----------------------------------------------------------------------


def conformer_rank(spark, sf):
    return mols.conformers(embeddings.molecules(spark, sf)).select(
        "target", "mol_id", "conf_id", "active", "energy", "conf_rank"
    )


def lec_conformers(spark, sf):
    lowest = mols.conformers(mols.lowest_energy(embeddings.molecules(spark, sf)))
    return lowest.select("target", "mol_id", "conf_id", "active", "energy")


def feature_projection(spark, sf):
    """Sum of the features of every descriptor width, per target."""
    parts = []
    for dtype in descriptors.DESCRIPTOR_TYPES:
        rows = mols.conformers(embeddings.molecules(spark, sf, dtype))
        total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
        parts.append(
            rows.groupBy("target", "dtype").agg(
                F.max(F.size("features")).cast("bigint").alias("width"),
                F.count(F.lit(1)).alias("conformers"),
                F.round(F.sum(total), 6).alias("total"),
            )
        )
    return mols.union_frames(*parts)


def target_label_counts(spark, sf):
    return mols.label_counts(embeddings.molecules(spark, sf))


def _numbered_library(spark, sf):
    """Actives of a target are its label's runs; its decoys, the next label's, number on from there."""
    library = embeddings.library(spark, sf).select(
        "label", F.floor(F.col("mol_id") / embeddings.TARGETS).cast("bigint").alias("run")
    )
    last = library.groupBy(F.col("label").alias("target")).agg(F.max("run").alias("last"))
    actives = library.select(F.col("label").alias("target"), F.lit(True).alias("active"), F.col("run").alias("mol_no"))
    decoys = (
        library.withColumn("target", (F.col("label") + embeddings.TARGETS - 1) % embeddings.TARGETS)
        .join(last, "target")
        .select("target", F.lit(False).alias("active"), (F.col("last") + 1 + F.col("run")).alias("mol_no"))
    )
    return actives.unionByName(decoys)


def numbering_gaps(spark, sf):
    return mols.numbering_gaps(_numbered_library(spark, sf))


def numbering_gaps_types(spark, sf):
    """All descriptor types in one table; one of them lacks every seventh file."""
    numbers = _numbered_library(spark, sf)
    typed = mols.union_frames(*[numbers.withColumn("dtype", F.lit(d)) for d in descriptors.DESCRIPTOR_TYPES])
    return mols.numbering_gaps(typed.filter((F.col("dtype") != "usr") | (F.col("mol_no") % 7 != 3)))


def _every_type(spark, sf):
    return mols.union_frames(*[embeddings.molecules(spark, sf, d) for d in descriptors.DESCRIPTOR_TYPES])


def label_counts_types(spark, sf):
    """Molecules of a target, and of each of its descriptor types."""
    every = _every_type(spark, sf)
    whole = mols.label_counts(every).withColumn("dtype", F.lit("all"))
    return whole.unionByName(mols.label_counts(every, ("target", "dtype")))


def resume_targets(spark, sf):
    keys = _keys(spark, sf)
    done = mols.label_counts(keys).filter(F.col("num_actives") >= 13)
    return pending_targets(mols.targets(keys), done)


def _descriptor_texts(spark, sf):
    """Every molecule as the text of a descriptor file; near-zero features are left empty."""
    cell = lambda v: F.when(F.abs(v) < 0.01, F.lit("")).otherwise(v.cast("string"))
    line = lambda c: F.concat_ws(
        ",",
        c["conf_id"].cast("string"),
        F.array_join(F.transform(c["features"], cell), ","),
        c["energy"].cast("string"),
        F.lit("0"),
    )
    by_id = F.array_sort(
        F.transform(
            "conformers",
            lambda c: F.struct(c["conf_id"].alias("conf_id"), c["energy"].alias("energy"), c["features"].alias("features")),
        )
    )
    # A molecule with a single conformer is written without it, so that it must be rejected.
    body = F.when(F.size("conformers") > 1, F.transform(by_id, line)).otherwise(F.array().cast("array<string>"))
    return embeddings.molecules(spark, sf).select(
        F.concat(F.lit("/home/"), F.col("target"), F.lit("/"), sampling.file_name(), F.lit(".es5")).alias("path"),
        F.array_join(F.concat(F.array(F.col("n_rot").cast("string")), body), "\n").alias("value"),
    )


def descriptor_scan(spark, sf):
    files = descriptors.parse_descriptors(_descriptor_texts(spark, sf), "es5")
    return files.groupBy(F.col("target").cast("bigint").alias("target")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.count_if(F.col("active")).alias("actives"),
        F.sum(F.when(F.col("reason").isNull(), F.size("conformers"))).alias("conformers"),
        F.sum(F.when(F.col("reason").isNull(), F.col("n_rot")).cast("bigint")).alias("rotatable"),
        F.round(F.sum(F.when(F.col("reason").isNull(), F.col("conformers")[0]["energy"])), 6).alias("lowest_energy"),
        F.round(
            F.sum(
                F.when(
                    F.col("reason").isNull(),
                    F.aggregate(F.col("conformers")[0]["features"], F.lit(0.0), lambda a, v: a + v),
                )
            ),
            6,
        ).alias("lowest_features"),
    )


def rejected_files(spark, sf):
    files = descriptors.parse_descriptors(_descriptor_texts(spark, sf), "es5")
    return descriptors.rejects(files).select(
        F.col("target").cast("bigint").alias("target"), "path", "active", "reason"
    )


def _files(spark, sf):
    files = descriptors.parse_descriptors(_descriptor_texts(spark, sf), "es5")
    return files.withColumn("target", F.col("target").cast("bigint"))


def sample_sequential_files(spark, sf):
    """Usable files in the order of their names, which are the reader's identifiers."""
    return sampling.draw(descriptors.molecules(_files(spark, sf)), (0.3, 0.8, 10.0), 1.0, 1.0, "SEQUENTIAL")


def sample_with_rejects(spark, sf):
    """Sample sizes come from all files, rejected ones too."""
    files = _files(spark, sf)
    totals = mols.label_counts(files)
    return sampling.draw(
        descriptors.molecules(files), (0.3, 0.8, 10.0), 1.0, 1.0, "SEQUENTIAL", totals=totals
    )


def mixture_status(spark, sf):
    """Which molecules have conformers enough for their own mixture."""
    return gmm.mixture_status(embeddings.molecules(spark, sf))


# ---- screening and evaluation ----------------------------------------------------------


def screen_all(spark, sf):
    return _scores(spark, sf)


def screen_lec(spark, sf):
    return _scores(spark, sf, "lec")


def screen_fraction(spark, sf):
    scores = experiment.screening_portions(embeddings.molecules(spark, sf))
    return _rounded(scores.drop("dtype"), 9, "score")


def screen_fraction_report(spark, sf):
    figures = experiment.screening_results(embeddings.molecules(spark, sf), sampling.PORTIONS[1:])
    return _rounded(figures.select("target", "portion", "auc", "auc_rank"), 6, "auc", "auc_rank")


def screening_descriptors(spark, sf):
    """All three descriptor types in one run, lowest-energy templates."""
    figures = experiment.screening_results(_every_type(spark, sf))
    columns = ("auc", "auc_rank", "ef_1", "ef_5")
    return _rounded(figures.select("target", "dtype", *columns), 6, *columns)


def screen_topk(spark, sf):
    best = nearest.screen_top(embeddings.molecules(spark, sf), 10, digits=9)
    return best.select(*SCORE_KEYS, F.col("position").cast("bigint").alias("position"))


def screening_report(spark, sf):
    return _rounded(_lists(spark, sf).figures(), 6, "auc", "auc_rank", "ef_1", "ef_5")


def auc_sim(spark, sf):
    return _rounded(_lists(spark, sf).auc(), 6, "auc")


def auc_rank(spark, sf):
    return _rounded(_lists(spark, sf).rank_auc(), 6, "auc_rank")


def average_rank(spark, sf):
    return _lists(spark, sf).average_ranks().select("target", "template_id", "score", "n", "avg_rank")


def roc_points(spark, sf):
    return _rounded(evaluation.roc_points(_scores(spark, sf), ["target"]), 9, "fpr", "tpr")


def enrichment(spark, sf):
    return _rounded(_lists(spark, sf).enrichment(), 6, "ef")


def mean_ef(spark, sf):
    return _rounded(_lists(spark, sf).mean_enrichment(), 6, "mean_ef")


def mean_ef_dist(spark, sf):
    """Low scores first, as for distances."""
    return _rounded(_lists(spark, sf).mean_enrichment(eval_method="dist"), 6, "mean_ef")


def auc_lineitem(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_suppkey", F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("truth")
    )
    return _rounded(evaluation.roc_auc(rows, ["l_suppkey"]), 6, "auc")


def _event_scores(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.lit("events").alias("source"),
        "event_id",
        F.col("value").alias("score"),
        (F.col("event_type") == "purchase").alias("truth"),
    )


def ef_events(spark, sf):
    efs = evaluation.enrichment(_event_scores(spark, sf), ["source"], identifier="event_id")
    return _rounded(efs, 6, "ef")


def report_documents(spark, sf):
    """Few distinct scores: document lengths in hundreds against the quality label, by language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id").select(
        "lang",
        "doc_id",
        F.floor(F.col("n_chars") / 100).cast("double").alias("score"),
        (F.col("quality") == 1).alias("truth"),
    )
    report = evaluation.evaluate(stage(rows, "documents"), ["lang"], identifier="doc_id")
    return _rounded(report, 6, "auc", "auc_rank", "ef_1", "ef_5")


# ---- sampling ----------------------------------------------------------------------------


def sample_sequential(spark, sf):
    return sampling.draw(_keys(spark, sf), (0.3, 0.8, 10.0), 1.0, 1.0, "SEQUENTIAL")


def sample_random(spark, sf):
    return sampling.draw(_keys(spark, sf), (0.3, 0.8, 10.0), 1.0, -1, "RANDOM", 7)


def sample_lumped(spark, sf):
    molecules = embeddings.molecules(spark, sf)
    sample = sampling.draw(molecules, (0.3,), 1.0, -1, "RANDOM", 7)
    rows = sampling.with_descriptors(sample, molecules, "LUMPED")
    return rows.select("target", "portion", "mol_id", "active", "conf_id", "conf_rank", "energy")


def sample_actives(spark, sf):
    return sampling.draw(_keys(spark, sf), (0.5,), 1.0, 0, "RANDOM", 7)


def take_portion(spark, sf):
    first = sampling.take_portion(_keys(spark, sf), 0.2, ["target"], "RANDOM", 3)
    second = sampling.take_portion(_keys(spark, sf), 30, ["target"], "RANDOM", 4, exclude=first)
    return first.withColumn("part", F.lit(1)).unionByName(second.withColumn("part", F.lit(2)))


def _sets(keys, portions):
    test, train = sampling.holdout(keys, portions)
    again = sampling.training_redraw(keys, test, portions)
    named = lambda df, name: df.withColumn("part", F.lit(name))
    return mols.union_frames(named(test, "test"), named(train, "train"), named(again, "redraw"))


def holdout(spark, sf):
    return _sets(stage(_keys(spark, sf), "keys"), (1.0,))


def portion_sweep(spark, sf):
    sets = _sets(stage(_keys(spark, sf), "keys"), sampling.PORTIONS)
    return sets.groupBy("target", "portion", "part").agg(
        F.count_if("active").alias("actives"), F.count_if(~F.col("active")).alias("decoys")
    )


def _folds(spark, sf, folds=5):
    return sampling.kfold(_keys(spark, sf), folds, ["target"], "RANDOM", 11)


def kfold(spark, sf):
    return _folds(spark, sf)


def kfold_sequential(spark, sf):
    name = F.concat(F.when(F.col("active"), "0").otherwise("1"), sampling.file_name())
    return sampling.kfold(_keys(spark, sf), 3, ["target"], "SEQUENTIAL", name=name)


def fold_train_counts(spark, sf):
    """Training molecules of each fold: all other folds, as a sum per fold less the fold's own."""
    per_fold = _folds(spark, sf).groupBy("target", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("active").alias("a")
    )
    total = per_fold.groupBy("target").agg(F.sum("n").alias("all_n"), F.sum("a").alias("all_a"))
    return per_fold.join(total, "target").select(
        "target",
        F.col("fold").alias("val_fold"),
        (F.col("all_n") - F.col("n")).alias("train"),
        (F.col("all_a") - F.col("a")).alias("train_actives"),
    )


# ---- models --------------------------------------------------------------------------------


def _dataset(spark, sf):
    return stage(as_dataset(embeddings.molecules(spark, sf)), "dataset")


def _model_scores(scores, digits=6):
    return _rounded(scores.select("target", "param", "mol_id", "score", "truth"), digits, "score")


def gmm1_diag_score(spark, sf):
    data = _dataset(spark, sf)
    return _model_scores(gmm.score(data, gmm.fit(training_rows(data), (1,), covariance="diag")))


def gmm1_full_score(spark, sf):
    data = _dataset(spark, sf)
    return _model_scores(gmm.score(data, gmm.fit(training_rows(data), (1,))))


def gmm1_lec_score(spark, sf):
    """Trained on lowest-energy conformers, scored on all."""
    data = _dataset(spark, sf)
    rows = training_rows(data, train_mode="lec")
    return _model_scores(gmm.score(data, gmm.fit(rows, (1,), covariance="diag")))


def gmm_fit(spark, sf):
    return gmm.components(gmm.fit(training_rows(_dataset(spark, sf)), gmm.COMPONENTS))


def gmm_score(spark, sf):
    data = _dataset(spark, sf)
    return _model_scores(gmm.score(data, gmm.fit(training_rows(data), gmm.COMPONENTS)))


def iforest_fit(spark, sf):
    return iforest.nodes(iforest.fit(training_rows(_dataset(spark, sf)), iforest.TREES))


def iforest_score(spark, sf):
    data = _dataset(spark, sf)
    return _model_scores(iforest.score(data, iforest.fit(training_rows(data), iforest.TREES)))


def ocsvm_score(spark, sf):
    data = _dataset(spark, sf)
    return _model_scores(ocsvm.score(data, ocsvm.fit(training_rows(data))))


def mlp_score(spark, sf):
    data = _dataset(spark, sf)
    return _model_scores(mlp.score(data, mlp.fit(training_rows(data, False))))


def mlp_activity_score(spark, sf):
    data = _dataset(spark, sf)
    models = mlp.fit(training_rows(data, False), tol=1e-3, activity_l2=mlp.ACTIVITY_L2)
    return _model_scores(mlp.score(data, models))


def mlp_lec_score(spark, sf):
    """Lowest-energy training conformers, early stopping on rows held out by hash."""
    data = _dataset(spark, sf)
    models = mlp.fit(training_rows(data, False, "lec"), early_stopping=True)
    return _model_scores(mlp.score(data, models))


def gmm_moments(spark, sf):
    """Mean and variance of each whole mixture: those of its training rows."""
    found = facts.mixture_moments(gmm.fit(training_rows(_dataset(spark, sf)), gmm.COMPONENTS))
    return _rounded(found.select("target", "param", "i", "mean", "variance"), 6, "mean", "variance")


def gmm_fold_moments(spark, sf):
    """The same for mixtures that leave a fold out."""
    data = _folded(spark, sf)
    found = facts.mixture_moments(gmm.fit(training_rows(data), (1, 10), range(3), covariance="diag"))
    return _rounded(found.select("target", "param", "fold", "i", "mean", "variance"), 6, "mean", "variance")


def _folded(spark, sf):
    """Molecules in three folds by a hash."""
    folds = sampling.kfold(_keys(spark, sf), 3, ["target"], "RANDOM", 11).select("target", "mol_id", "fold")
    return stage(_dataset(spark, sf).drop("fold").join(folds, ["target", "mol_id"]), "folded")


def gmm_rescored(spark, sf):
    data = _dataset(spark, sf)
    models = gmm.fit(training_rows(data), gmm.COMPONENTS, covariance="diag")
    return facts.rescored_mixtures(data, models)


def iforest_facts(spark, sf):
    found = facts.forest_facts(iforest.fit(training_rows(_dataset(spark, sf)), iforest.TREES))
    return found.select("target", "param", "trees", "sample", "leaf_rows", "broken")


def iforest_rescored(spark, sf):
    """The smallest forest of the grid, walked by lookups."""
    data = _dataset(spark, sf)
    return facts.rescored_forests(data, iforest.fit(training_rows(data), iforest.TREES[-1:]))


def mlp_rescored(spark, sf):
    data = _dataset(spark, sf)
    return facts.rescored_units(data, mlp.fit(training_rows(data, False)), "mlp")


def ocsvm_rescored(spark, sf):
    data = _dataset(spark, sf)
    return facts.rescored_units(data, ocsvm.fit(training_rows(data)), "ocsvm")


def _mixtures(spark, sf, covariance, one=False):
    molecules = embeddings.molecules(spark, sf)
    k = F.lit(1) if one else None
    return stage(gmm.molecule_mixtures(molecules, covariance, k), "mixtures")


def _signed_log(scores):
    """Mixture scores span many orders of magnitude; compare their logarithms."""
    return scores.select(
        "target",
        "template_id",
        "mol_id",
        F.round(F.signum("score") * F.log1p(F.abs("score")), 6).alias("score"),
        "truth",
    )


def mol_nmp(spark, sf):
    return _signed_log(
        gmm.screen_mixtures(_mixtures(spark, sf, "diag", True), gaussians.normal_product_distance())
    )


def _mol_diag(kernel, log):
    def query(spark, sf):
        block = gaussians.mixture_kernel(kernel, log=log, full=False)
        return _signed_log(gmm.screen_mixtures(_mixtures(spark, sf, "diag", True), block))

    return query


mol_expected_likelihood = _mol_diag(gaussians.log_expected_likelihood, True)
mol_bhattacharyya = _mol_diag(gaussians.log_bhattacharyya, True)
mol_bhattacharyya2 = _mol_diag(gaussians.log_bhattacharyya_sum, True)
mol_bhattacharyya2_distance = _mol_diag(gaussians.log_bhattacharyya_distance, False)


def _mol_full(kernel):
    def query(spark, sf):
        block = gaussians.mixture_kernel(kernel, log=True)
        return _signed_log(gmm.screen_mixtures(_mixtures(spark, sf, "full"), block))

    return query


mol_expected_likelihood_full = _mol_full(gaussians.log_expected_likelihood)
mol_bhattacharyya_full = _mol_full(gaussians.log_bhattacharyya)
mol_bhattacharyya2_full = _mol_full(gaussians.log_bhattacharyya_sum)


def mol_nmp_components(spark, sf):
    """Component count from the rotatable bonds of each molecule."""
    return _signed_log(
        gmm.screen_mixtures(_mixtures(spark, sf, "diag"), gaussians.normal_product_distance())
    )


# ---- experiments -----------------------------------------------------------------------------


def _feature_figures(spark, sf):
    """Cross-validation figures of deterministic models: score = one feature of the lowest-energy pose."""
    lowest = embeddings.molecules(spark, sf).select(
        "target", "mol_id", F.col("conformers")[0]["features"].alias("x")
    )
    params = F.explode(F.array(*[F.lit(p) for p in FEATURE_PARAMS])).alias("param")
    scores = (
        sampling.kfold(_keys(spark, sf), 3, ["target"], "RANDOM", 11)
        .join(lowest, ["target", "mol_id"])
        .select("target", F.lit(1.0).alias("portion"), "fold", "mol_id", F.col("active").alias("truth"), "x", params)
        .withColumn("score", F.get("x", F.col("param") - 1))
        .drop("x")
    )
    key = ["target", "portion", "param", "fold"]
    return evaluation.evaluate(stage(scores, "feature-scores"), key)


def xval_summary(spark, sf):
    summary = experiment.xval_summary(_feature_figures(spark, sf))
    columns = ("mean_auc", "std_auc", "mean_auc_rank", "mean_ef_5", "std_ef_5")
    return _rounded(
        summary.select("target", "portion", "param", "folds", *columns, "status"), 6, *columns
    )


def best_param(spark, sf):
    summary = experiment.xval_summary(_feature_figures(spark, sf))
    return experiment.best_param(summary, "auc", FEATURE_PARAMS)


def _cross_validated(spark, sf, family, train_mode="all"):
    """The split and the figures of a family's whole grid, folds and portions."""
    data = experiment.split(embeddings.molecules(spark, sf), sampling.PORTIONS, family.folds)
    return data, experiment.xval_summary(experiment.cross_validate(data, family, train_mode=train_mode))


def _xval(name, train_mode="all"):
    def query(spark, sf):
        return _cross_validated(spark, sf, FAMILIES[name], train_mode)[1]

    return query


gmm_xval = _xval("gmm")
gmm_lec_xval = _xval("gmm", "lec")
iforest_xval = _xval("iforest")
mlp_xval = _xval("mlp")
ocsvm_xval = _xval("ocsvm")


def final_eval(spark, sf):
    result = experiment.run(embeddings.molecules(spark, sf), FAMILIES["gmm_auc"])
    columns = ("auc", "auc_rank", "ef_1", "ef_5")
    return _rounded(result.final.drop("elapsed_s"), 6, *columns)


def resumed_run(spark, sf):
    """A stored experiment that is stopped twice and resumed, read back: rows and runs of each target.

    The first run finishes one target; the second stops after its results, before its models and
    its commit; the third does what is left.
    """
    data = stage(embeddings.molecules(spark, sf), "molecules")
    folder = f"{stage_folder(spark)}/runs-{uuid.uuid4().hex}"
    options = {"portions": (1.0, 0.5), "features": 64}
    experiment.resume(data.filter("target = 0"), FAMILIES["ocsvm"], folder, **options)
    stopped = RunLog(spark, folder)
    left = stopped.read("results").withColumn("target", F.lit(1).cast("bigint")).drop("run")
    stopped.write("results", stopped.start(), left)
    log = experiment.resume(data, FAMILIES["ocsvm"], folder, **options)
    counted = lambda kind: log.read(kind).groupBy("target").agg(
        F.count("*").alias(kind), F.min("run").alias(f"{kind}_run"), F.count_distinct("run").alias(f"{kind}_runs")
    )
    together = (F.col("results_run") == F.col("models_run")) & (F.col("results_runs") == 1) & (F.col("models_runs") == 1)
    return counted("results").join(counted("models"), "target").select(
        "target", "results", "models", together.alias("together")
    )


def refit_model(spark, sf):
    family = FAMILIES["gmm"]
    data, summary = _cross_validated(spark, sf, family)
    best = stage(experiment.best_param(stage(summary, "xval"), family.metric, family.params), "best")
    return gmm.components(experiment.refit(data, family, best))


_QUERIES = (
    conformer_rank, lec_conformers, feature_projection, target_label_counts, numbering_gaps,
    numbering_gaps_types, label_counts_types, sample_sequential_files, sample_with_rejects, mixture_status,
    resume_targets, descriptor_scan, rejected_files,
    screen_all, screen_lec, screen_fraction, screen_fraction_report, screen_topk, screening_report,
    screening_descriptors,
    auc_sim, auc_rank, average_rank, roc_points, enrichment, mean_ef, mean_ef_dist,
    auc_lineitem, ef_events, report_documents,
    sample_sequential, sample_random, sample_lumped, sample_actives, take_portion, holdout, portion_sweep,
    kfold, kfold_sequential, fold_train_counts,
    gmm1_diag_score, gmm1_lec_score, gmm1_full_score, gmm_fit, gmm_score,
    iforest_fit, iforest_score, ocsvm_score, mlp_score, mlp_activity_score, mlp_lec_score,
    gmm_moments, gmm_fold_moments, gmm_rescored, iforest_facts, iforest_rescored, mlp_rescored, ocsvm_rescored,
    mol_nmp, mol_nmp_components, xval_summary, best_param, final_eval, refit_model, resumed_run,
)
_NAMED = (
    "mol_expected_likelihood", "mol_bhattacharyya", "mol_bhattacharyya2", "mol_bhattacharyya2_distance",
    "mol_expected_likelihood_full", "mol_bhattacharyya_full", "mol_bhattacharyya2_full",
    "gmm_xval", "gmm_lec_xval", "iforest_xval", "mlp_xval", "ocsvm_xval",
)


def _with_package(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    named = {q.__name__: q for q in _QUERIES} | {name: globals()[name] for name in _NAMED}
    return {name: _with_package(query) for name, query in named.items()}
