"""Failure-risk models over prefix features, as pyspark.ml pipelines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from trailcast.operators import boosting as BO
from trailcast.operators.calibration import Calibrator, read_text, write_text
from trailcast.operators.features import family_columns
from trailcast.operators.labels import feature, rule_score, shuffled_labels, to_numbers
from trailcast.operators.metrics import roc_auc
from trailcast.operators.ordering import attach
from trailcast.operators.prefixes import TEXT_COLUMN, feature_columns
from trailcast.operators.resampling import paired_auc_delta
from trailcast.operators.splits import group_kfold
from trailcast.operators.text_weights import SublinearTfIdf
from trailcast.session import cut_lineage, reuse, shared_folder

# Training settings of the model roster.
LOGISTIC_ITERATIONS = 2000
FOREST_TREES = 300
FOREST_LEAF = 5
FOREST_DEPTH = 30  # the most that pyspark.ml allows
#: Rows times trees of one forest fit, about: the driver holds all nodes of a fit, one for about 15 of these.
FOREST_ROWS = 1_000_000
#: Parts of a forest, at most, that are grown or scored at once, and rows of a task of a fit, about.
FOREST_AT_ONCE, FOREST_TASK_ROWS = 8, 150_000
BOOSTED = BO.Settings(rounds=300, rate=0.08, l2=1.0)


@dataclass
class RiskModel:
    """A fitted scorer: constant, rule, boosted trees, pipeline, or stored pipelines that each count for some trees."""

    name: str
    columns: list[str] = field(default_factory=list)
    pipeline: PipelineModel | None = None
    constant: float | None = None
    boosted: BO.Boosters | None = None
    parts: list[tuple[str, int]] = field(default_factory=list)

    def score(self, df: DataFrame, out: str = "risk") -> DataFrame:
        if self.constant is not None:
            return df.withColumn(out, F.lit(self.constant))
        if self.parts:
            return self._score_parts(df, out)
        if self.pipeline is None and self.boosted is None:
            return df.withColumn(out, rule_score(df))
        if self.boosted is not None:
            return df.withColumn(out, self.boosted.risk(values=[feature(df, c) for c in self.columns]))
        keep = df.columns
        scored = self.pipeline.transform(_inputs(df, self.columns))
        return scored.select(*keep, vector_to_array("probability")[1].alias(out))

    def _score_parts(self, df: DataFrame, out: str) -> DataFrame:
        """Mean over the trees of all parts; a few parts are in memory at a time and score in one job."""
        keep, total = df.columns, sum(n for _, n in self.parts)
        rows = df.withColumn("_votes", F.lit(0.0))
        with ThreadPoolExecutor(FOREST_AT_ONCE) as pool:
            for start in range(0, len(self.parts), FOREST_AT_ONCE):
                some = self.parts[start:start + FOREST_AT_ONCE]
                loaded = list(pool.map(PipelineModel.load, [path for path, _ in some]))
                scored = loaded[0].stages[0].transform(_inputs(rows, self.columns))  # all parts have the same features
                for (_, n), forest in zip(some, loaded):
                    votes = F.col("_votes") + n * vector_to_array("probability")[1]
                    scored = forest.stages[-1].transform(scored).select(*keep, "features", votes.alias("_votes"))
                rows = cut_lineage(scored.select(*keep, "_votes"))
        return rows.select(*[c for c in keep if c != out], (F.col("_votes") / total).alias(out))

    def save(self, path: str) -> None:
        """Write name, columns and whatever was fitted; every kind of model can be saved."""
        spark = SparkSession.active()
        body = {"name": self.name, "columns": self.columns, "constant": self.constant,
                "boosted": self.boosted.to_json() if self.boosted else None, "pipeline": self.pipeline is not None,
                "parts": [n for _, n in self.parts]}
        write_text(spark, json.dumps(body), f"{path}/model")
        for i, (own, _) in enumerate(self.parts):
            PipelineModel.load(own).write().overwrite().save(f"{path}/part{i}")
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")

    @staticmethod
    def load(path: str) -> RiskModel:
        body = json.loads(read_text(SparkSession.active(), f"{path}/model"))
        return RiskModel(body["name"], body["columns"], PipelineModel.load(f"{path}/pipeline") if body["pipeline"] else None,
                         body["constant"], BO.Boosters.from_json(body["boosted"]) if body["boosted"] else None,
                         [(f"{path}/part{i}", n) for i, n in enumerate(body.get("parts", []))])


def save_bundle(path: str, model: RiskModel, calibrator: Calibrator | None = None) -> None:
    """A model together with the calibrator of its scores."""
    model.save(f"{path}/scorer")
    (calibrator or Calibrator("identity")).save(f"{path}/calibrator")


def load_bundle(path: str) -> tuple[RiskModel, Calibrator]:
    return RiskModel.load(f"{path}/scorer"), Calibrator.load(f"{path}/calibrator")


def _inputs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature columns as doubles and the text without NULLs."""
    out = to_numbers(df, columns) if columns else df
    if TEXT_COLUMN in df.columns:
        out = out.withColumn(TEXT_COLUMN, F.coalesce(TEXT_COLUMN, F.lit("")))
    return out


def balanced_weights(df: DataFrame, label: str = "y_fail", weight: str | None = None) -> DataFrame:
    """Add ``_w``: rows over twice the rows of the class, times a given weight."""
    sizes = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("double")).alias("_pos"))
    own = F.when(F.col(label) == 1, F.col("_pos")).otherwise(F.col("_n") - F.col("_pos"))
    w = F.col("_n") / (2 * own)
    return attach(df, sizes).withColumn("_w", w if weight is None else w * F.col(weight)).drop("_n", "_pos")


def _assemble(columns: list[str], scaled: bool) -> list:
    stages = [VectorAssembler(inputCols=columns, outputCol="raw_features" if scaled else "features")]
    if scaled:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features"))
    return stages


def _logistic(n_rows: int, iterations: int = LOGISTIC_ITERATIONS) -> LogisticRegression:
    """Penalty strength 1 over the sum of losses is 1 / n over their mean."""
    return LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", maxIter=iterations,
                              regParam=1.0 / max(1, n_rows), standardization=False)


def logistic_pipeline(columns: list[str], n_rows: int, iterations: int = LOGISTIC_ITERATIONS, **_) -> Pipeline:
    return Pipeline(stages=[*_assemble(columns, True), _logistic(n_rows, iterations)])


def forest_pipeline(columns: list[str], n_rows: int, trees: int = FOREST_TREES, seed: int = 42, **_) -> Pipeline:
    # Each row's node is kept from level to level; else all trees go to all tasks anew at each level.
    forest = RandomForestClassifier(labelCol="_y", weightCol="_w", numTrees=trees, minInstancesPerNode=FOREST_LEAF,
                                    maxDepth=FOREST_DEPTH, cacheNodeIds=True, seed=seed)
    return Pipeline(stages=[*_assemble(columns, False), forest])


def text_pipeline(columns: list[str], n_rows: int, iterations: int = LOGISTIC_ITERATIONS,
                  vocabulary: int = 100_000, **_) -> Pipeline:
    """Numbers next to TF-IDF of the prefix text over its most frequent words and word pairs together."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="raw_features"),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="numbers"),
        RegexTokenizer(inputCol=TEXT_COLUMN, outputCol="words", pattern=r"\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="term_counts", minDF=2.0, vocabSize=vocabulary),
        SublinearTfIdf(inputCol="term_counts", outputCol="term_weights"),
        VectorAssembler(inputCols=["numbers", "term_weights"], outputCol="features"),
        _logistic(n_rows, iterations)])


# Model roster by name; the first two and the boosted trees fit no pipeline.
FACTORIES: dict[str, Callable[..., Pipeline]] = {
    "baseline_step_count_only": logistic_pipeline,
    "logistic_regression": logistic_pipeline,
    "random_forest": forest_pipeline,
    "structured_plus_tfidf_logistic": text_pipeline,
}
BOOSTING = "gradient_boosting"
ROSTER = ["baseline_majority", "heuristic_rule_monitor", *FACTORIES, BOOSTING]


def fit(name: str, train: DataFrame, columns: list[str] | None = None, label: str = "y_fail",
        weight: str | None = None, **settings) -> RiskModel:
    """Fit one model of the roster. ``columns`` defaults to all features (step counts for the baseline)."""
    if name == "baseline_majority":
        return RiskModel(name, constant=train.agg(F.avg(F.col(label).cast("double"))).first()[0])
    if name == "heuristic_rule_monitor":
        return RiskModel(name)
    if columns is None:
        columns = (family_columns(train.columns, ["step_count_only"]) if name == "baseline_step_count_only"
                   else feature_columns(train))
    if name == BOOSTING:
        boosted = BO.fit_many(_inputs(train, columns), columns, replace(BOOSTED, **settings), label=label, weight=weight)
        if not boosted.trees:
            raise ValueError(f"no rows to train {name} on")
        return RiskModel(name, columns, boosted=boosted)
    rows = balanced_weights(train, label, weight)
    text = [TEXT_COLUMN] if FACTORIES[name] is text_pipeline else []
    rows = _inputs(rows.select(*columns, *text, "_w", F.col(label).cast("double").alias("_y")), columns)
    rows = reuse(rows)
    n_rows = rows.count()
    if n_rows == 0:
        raise ValueError(f"no rows to train {name} on")
    if FACTORIES[name] is forest_pipeline:
        model = _fit_forest(name, rows, columns, n_rows, **settings)
    else:
        model = RiskModel(name, columns, FACTORIES[name](columns, n_rows, **settings).fit(rows))
    rows.unpersist()  # a fold's rows are not kept beside those of the next one
    return model


def fit_all(names: list[str], train: DataFrame) -> dict[str, RiskModel]:
    """Models of the roster by name, fitted side by side: each is a chain of small jobs that leaves cores idle."""
    with ThreadPoolExecutor(max(1, len(names))) as pool:
        return dict(zip(names, pool.map(lambda n: fit(n, train), names)))


def _fit_forest(name: str, rows: DataFrame, columns: list[str], n_rows: int, trees: int = FOREST_TREES,
                seed: int = 42, **settings) -> RiskModel:
    """One forest, or forests of fewer trees each that are stored as soon as they are fitted. Trees are grown
    apart from each other and count alike, so these are one forest of all the trees."""
    k = min(trees, -(-trees * n_rows // FOREST_ROWS))
    if k <= 1:
        return RiskModel(name, columns, forest_pipeline(columns, n_rows, trees, seed, **settings).fit(rows))
    folder = f"{shared_folder(rows.sparkSession)}/forest-{uuid.uuid4().hex}"
    # Deep levels bring the sums of all their nodes from every task: a fit gets few tasks, and fits go side by side.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = -(-n_rows // FOREST_TASK_ROWS)
    few = rows.coalesce(tasks)

    def grow(i: int) -> tuple[str, int]:
        own = (i + 1) * trees // k - i * trees // k
        forest_pipeline(columns, n_rows, own, seed + i, **settings).fit(few).write().save(f"{folder}/{i}")
        return f"{folder}/{i}", own

    with ThreadPoolExecutor(max(1, min(FOREST_AT_ONCE, cores // tasks))) as pool:
        parts = list(pool.map(grow, range(k)))
    return RiskModel(name, columns, parts=parts)


def fit_boosted(train: DataFrame, columns_of: dict[str, list[str]], label: str = "y_fail", weight: str | None = None,
                **settings) -> dict[str, RiskModel]:
    """Boosted models of several column sets, all grown side by side."""
    columns = list(dict.fromkeys(c for own in columns_of.values() for c in own))
    names = F.array(*[F.lit(n) for n in columns_of])
    found = BO.fit_many(_inputs(train, columns).withColumn("_models", names), columns, replace(BOOSTED, **settings),
                        "_models", columns_of, label, weight)
    return {n: RiskModel(BOOSTING, columns, boosted=BO.Boosters(columns, {n: t})) for n, t in found.trees.items()}


def fit_families(train: DataFrame, families: list[list[str]], name: str = BOOSTING, **settings) -> dict[str, RiskModel]:
    """Models restricted to feature families; families with text use the text model."""
    text = [f for f in families if "all_structured_plus_text" in f]
    plain = [f for f in families if f not in text]
    with ThreadPoolExecutor(max(1, len(text))) as pool:
        waiting = [pool.submit(fit, "structured_plus_tfidf_logistic", train, family_columns(train.columns, f)) for f in text]
        if name == BOOSTING:
            models = fit_boosted(train, {"+".join(f): family_columns(train.columns, f) for f in plain}, **settings)
        else:
            models = {"+".join(f): fit(name, train, family_columns(train.columns, f), **settings) for f in plain}
        models |= {"+".join(f): w.result() for f, w in zip(text, waiting)}
    for label, model in models.items():
        model.name = f"ablation::{label}"
    return {"+".join(f): models["+".join(f)] for f in families}


def fit_shuffled(train: DataFrame, name: str = "logistic_regression", seed: int = 42, **settings) -> RiskModel:
    """Control model trained on shuffled labels; it should rank no better than chance."""
    return fit(name, shuffled_labels(train, seed=seed), feature_columns(train), label="y_shuffled", **settings)


def out_of_fold(df: DataFrame, name: str, k: int = 5, group: str = "instance_id", out: str = "risk",
                by: list[str] | None = None, **settings) -> DataFrame:
    """Score every row with a model that never saw its group, for each set of rows ``by``.

    Boosted models of all sets and folds are grown side by side; other models are fitted one after another.
    """
    by = by or []
    folds = reuse(df.join(group_kfold(df, group, k, by), [*by, group]))
    if name == BOOSTING:
        columns = feature_columns(df)
        label = settings.pop("label", "y_fail")

        def named(fold):
            return F.concat_ws("|", *[F.col(c).cast("string") for c in by], fold.cast("string"))

        others = F.transform(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: x != F.col("fold")), named)
        found = BO.fit_many(_inputs(folds, columns).withColumn("_models", others), columns, replace(BOOSTED, **settings),
                            "_models", label=label)
        return folds.withColumn(out, found.risk(named(F.col("fold")), [feature(folds, c) for c in columns]))
    if by:
        raise ValueError(f"{name} is fitted for one set of rows at a time")
    scored = None
    for i in range(k):
        model = fit(name, folds.where(F.col("fold") != i), feature_columns(df), **settings)
        part = model.score(folds.where(F.col("fold") == i), out)
        scored = part if scored is None else scored.unionByName(part)
    return scored


def importance(model: RiskModel) -> DataFrame:
    """Standardized logistic coefficients, strongest first."""
    last = model.pipeline.stages[-1]
    rows = [(c.removeprefix("f__"), float(v)) for c, v in zip(model.columns, last.coefficients.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, coef double").orderBy(
        F.abs("coef").desc(), "feature")


def blend(validation: DataFrame, test: DataFrame, scores: list[str], steps: int = 10) -> tuple[str, DataFrame]:
    """Best of mean, weighted grid and stacked blend by validation AUC; returns its name and scored test rows.

    All grid points are evaluated in one job: each row's blends are exploded and the AUC
    is grouped by grid point.
    """
    points = [(i, j, steps - i - j) for i in range(steps + 1) for j in range(steps + 1 - i)] if len(scores) == 3 else [
        (i, steps - i) for i in range(steps + 1)]

    def mix(weights) -> F.Column:
        total = F.lit(0.0)
        for w, s in zip(weights, scores):
            total = total + F.lit(w / steps) * F.col(s)
        return total

    mean = sum((F.col(s) for s in scores[1:]), F.col(scores[0])) / len(scores)
    options = F.array(*[F.struct(F.lit(i).alias("point"), F.round(mix(w), 12).alias("p")) for i, w in enumerate(points)],
                      F.struct(F.lit(-1).alias("point"), F.round(mean, 12).alias("p")))
    aucs = roc_auc(validation.select("y_fail", F.explode(options).alias("o")).select("y_fail", "o.point", "o.p"),
                   "p", by=["point"])
    ranked = {r.point: r.auc for r in aucs.collect()}  # one row per grid point
    best = max((p for p in ranked if p >= 0), key=lambda p: (ranked[p] or 0.0, -p))
    stack = Pipeline(stages=[
        VectorAssembler(inputCols=scores, outputCol="features"),
        LogisticRegression(labelCol="_y", maxIter=1000, regParam=0.0)]).fit(
        validation.withColumn("_y", F.col("y_fail").cast("double")))

    def stacked(df: DataFrame) -> DataFrame:
        return stack.transform(df).withColumn("blend", vector_to_array("probability")[1]).select(*df.columns, "blend")

    results = {"mean": ranked[-1], "weighted": ranked[best], "stack": roc_auc(stacked(validation), "blend").first().auc}
    winner = max(results, key=lambda n: results[n] or 0.0)
    if winner == "stack":
        return winner, stacked(test)
    return winner, test.withColumn("blend", mean if winner == "mean" else mix(points[best]))


def compare_candidates(train: DataFrame, validation: DataFrame, test: DataFrame, candidates: dict[str, list[str]],
                       base: str, name: str = "gradient_boosting", n_boot: int = 1000, **settings) -> DataFrame:
    """Choose a feature set on validation, then one paired test of the winner against the base set."""
    models = fit_boosted(train, candidates, **settings) if name == BOOSTING else {
        c: fit(name, train, cols, **settings) for c, cols in candidates.items()}
    val = {c: roc_auc(m.score(validation)).first().auc or 0.0 for c, m in models.items()}
    winner = max(val, key=lambda c: val[c])
    scored = models[winner].score(models[base].score(test, "p_base"), "p_new")
    return paired_auc_delta(reuse(scored), "p_base", "p_new", n_boot=n_boot).withColumns({
        "base": F.lit(base), "winner": F.lit(winner), "val_base": F.lit(val[base]), "val_winner": F.lit(val[winner])})


def vector_probe(df: DataFrame, k: int = 5, group: str = "grp", strength: float = 0.05) -> DataFrame:
    """Grouped cross-validation AUC of a logistic probe on vectors (``vec``, ``y``)."""
    rows = reuse(df.withColumn("raw_features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
                 .withColumn("_y", F.col("y").cast("double")).join(group_kfold(df, group, k), group))
    sizes = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # k rows
    scored = None
    for i in range(k):
        n = sum(v for f, v in sizes.items() if f != i)
        model = Pipeline(stages=[
            StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features"),
            LogisticRegression(labelCol="_y", maxIter=200, regParam=1.0 / (strength * max(1, n)))]).fit(
            rows.where(F.col("fold") != i))
        part = model.transform(rows.where(F.col("fold") == i)).select(
            "fold", "y", vector_to_array("probability")[1].alias("p"))
        scored = part if scored is None else scored.unionByName(part)
    return roc_auc(scored, "p", "y", ["fold"]).agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("auc_sd"))
