"""Win probability: feature table, logistic model, calibration, temporal validation and scoring of fixtures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import KEYS
from .history import last_k, positions, temporal_cut, temporal_folds
from .newton import Linear, fit_many, margin, scales_of, standardised
from .scan import counts_below, form_before

ANALYSIS = ("delta_efg_pct", "delta_tov_pct", "delta_orb_pct", "delta_ftr", "delta_net_rating", "home", "rest_diff", "net_rating_ewm", "efg_pct_ewm", "tov_pct_ewm")
PREGAME = ("home", "net_rating_ewm", "win_last5", "paint_efg_ewm", "fg3_pct_ewm")
EWM_METRICS = ("net_rating", "efg_pct", "tov_pct", "orb_pct", "ftr", "ortg", "drtg", "pace", "clutch_net", "paint_efg", "paint_rate", "fg3_pct")
STRENGTH_C = 0.2


def feature_table(team_game: DataFrame, events: DataFrame | None = None, shots: DataFrame | None = None, keys: Sequence[str] = KEYS, span: int = 10) -> DataFrame:
    """Four Factors rows with event and shot features attached (missing stay null) and their leak-free history.

    The history runs over ranges of games with carried totals, so a team's games may be any number.
    """
    t = team_game.withColumns({"home": F.col("is_home").cast("int"), "win": F.col("won").cast("int"), "fg3_pct": F.try_divide(F.col("fg3m").cast("double"), F.col("fg3a"))})
    for extra in (events, shots):
        if extra is not None:
            t = t.join(extra, [*keys, "game", "team"], "left")
    have = [m for m in EWM_METRICS if m in t.columns]
    return form_before(t, [*keys, "team"], ["date", "game"], have, "win", span)


def scaling(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature (a deviation of 0 counts as 1)."""
    row = train.agg(*(F.avg(f).alias(f"m_{f}") for f in features), *(F.stddev_pop(f).alias(f"s_{f}") for f in features)).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}


class WinModel:
    """A standardised L2 logistic regression; with calibration, the mean of the Platt-scaled fold models."""

    def __init__(self, features: Sequence[str], scale: dict, models: list[Linear], platt: list[tuple[float, float]], meta: dict) -> None:
        self.features, self.scale, self.models, self.platt, self.meta = tuple(features), scale, models, platt, meta

    def transform(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Probability of a win for every row; a null feature counts as the training mean."""
        filled = df.withColumns({f"_f_{f}": F.coalesce(F.col(f).cast("double"), F.lit(self.scale[f][0])) for f in self.features})
        z = lambda f: (F.col(f"_f_{f}") - F.lit(self.scale[f][0])) / F.lit(self.scale[f][1])
        total = F.lit(0.0)
        for model, (a, b) in zip(self.models, self.platt):
            margin = F.lit(float(model.intercept))
            for f, w in zip(self.features, model.coefficients):
                margin = margin + F.lit(float(w)) * z(f)
            total = total + F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * margin + F.lit(b))))
        return filled.withColumn(out, total / len(self.models)).drop(*(f"_f_{f}" for f in self.features))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Mean standardised coefficients, the largest first."""
        k = len(self.models)
        rows = [(f, sum(float(m.coefficients[i]) for m in self.models) / k) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of plain arrays: features, scales, models, calibrations and metadata."""
        models = [(float(m.intercept), [float(w) for w in m.coefficients]) for m in self.models]
        rows = [(list(self.features), [list(map(float, self.scale[f])) for f in self.features], models, [list(map(float, p)) for p in self.platt], {k: str(v) for k, v in self.meta.items()})]
        schema = "features array<string>, scale array<array<double>>, models array<struct<intercept:double,coefficients:array<double>>>, platt array<array<double>>, meta map<string,string>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "WinModel":
        r = spark.read.parquet(f"{path}/metadata").first()
        models = [Linear(m["intercept"], tuple(m["coefficients"])) for m in r["models"]]
        return cls(r["features"], dict(zip(r["features"], map(tuple, r["scale"]))), models, [tuple(p) for p in r["platt"]], dict(r["meta"]))


def train(rows: DataFrame, features: Sequence[str] = PREGAME, label: str = "win", c: float = STRENGTH_C) -> WinModel:
    """One uncalibrated model over rows without nulls."""
    rows = rows.dropna(subset=[*features, label]).cache()
    one = F.array(F.lit(0))
    scales, sizes = scales_of(rows, features, one, 1)
    models = fit_many(rows, one, 1, standardised(features, scales, F.col("_m")), F.col(label), c)
    rows.unpersist()
    return WinModel(features, scales[0], models, [(1.0, 0.0)], {"n_rows": sizes[0], "trained_at": datetime.now(timezone.utc).isoformat()})


def stratified_folds(rows: DataFrame, label: str, date: str, order: Sequence[str], folds: int) -> DataFrame:
    """fold 0 .. folds-1: a contiguous block of each class in row order."""
    placed = positions(rows, date, order, "_at", partition=[label])
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))  # two rows
    return placed.join(F.broadcast(counts), label).withColumn("fold", F.floor(F.col("_at") * folds / F.col("_n")).cast("int")).drop("_at", "_n")


def train_calibrated(rows: DataFrame, features: Sequence[str] = PREGAME, label: str = "win", date: str = "date", order: Sequence[str] = ("game", "team"), folds: int = 5, c: float = STRENGTH_C) -> WinModel:
    """Platt-calibrated mean of ``folds`` models, each calibrated on the part it has not seen.

    The folds' models are fitted together, and so are their sigmoids: unregularised one-feature regressions on Platt's soft targets.
    """
    rows = stratified_folds(rows.dropna(subset=[*features, label]), label, date, order, folds).cache()
    n, scale = rows.count(), scaling(rows, features)
    scales = [scale] * folds
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    models = fit_many(rows, others, folds, standardised(features, scales, F.col("_m")), F.col(label), c)
    held = rows.select("fold", F.col(label).cast("double").alias("_y"), margin(standardised(features, scales, F.col("fold")), F.col("fold"), models).alias("_x"))
    sizes = {r["fold"]: r for r in held.groupBy("fold").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")).collect()}
    high = F.array(*(F.lit((sizes[k]["pos"] + 1) / (sizes[k]["pos"] + 2) if k in sizes else 1.0) for k in range(folds)))
    low = F.array(*(F.lit(1 / (sizes[k]["neg"] + 2) if k in sizes else 0.0) for k in range(folds)))
    target = F.when(F.col("_y") == 1, F.get(high, F.col("fold"))).otherwise(F.get(low, F.col("fold")))
    sigmoids = fit_many(held, F.array("fold"), folds, [F.col("_x")], target, None)
    platt = [(s.coefficients[0], s.intercept) for s in sigmoids]
    last = str(rows.agg(F.max(date)).first()[0])
    rows.unpersist()
    return WinModel(features, scale, models, platt, {"n_rows": n, "last_date": last, "trained_at": datetime.now(timezone.utc).isoformat()})


def metrics(scored: DataFrame, label: str = "win", prob: str = "prob", group: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """n, accuracy, auc (rank sum with mean ranks of ties) and log loss per group, without leaving the executors.

    Ranks come from counts per distinct probability, so ties cost nothing, and from ranges of probabilities with carried counts, so that no
    task sees all of them however they are spread.
    """
    p, y = F.col(prob), F.col(label).cast("double")
    clipped = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    per = scored.groupBy(*group, p.alias("_p")).agg(F.count("*").alias("_n"), F.sum(y).alias("_pos"), F.sum(-(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("_loss"), F.count_if((p >= threshold) == (y == 1)).alias("_ok"))
    per = counts_below(per, group, "_p", "_n").withColumn("_rank", F.col("_below") + (F.col("_n") + 1) / 2)
    out = per.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("_p1"), F.sum(F.col("_pos") * F.col("_rank")).alias("_ranks"), F.sum("_loss").alias("_loss"), F.sum("_ok").alias("_ok"))
    neg = F.col("n") - F.col("_p1")
    return out.select(*group, "n", (F.col("_ok") / F.col("n")).alias("accuracy"), F.try_divide(F.col("_ranks") - F.col("_p1") * (F.col("_p1") + 1) / 2, F.col("_p1") * neg).alias("auc"), (F.col("_loss") / F.col("n")).alias("log_loss"))


def train_holdout(rows: DataFrame, features: Sequence[str] = PREGAME, label: str = "win", date: str = "date", order: Sequence[str] = ("game", "team"), share: float = 0.75, c: float = STRENGTH_C) -> tuple[WinModel, DataFrame]:
    """A model of the first ``share`` of the rows in time, and the remaining rows scored by it; ``metrics`` evaluates them."""
    cut = temporal_cut(rows.dropna(subset=[*features, label]), date, order, share)
    model = train(cut.where("is_train"), features, label, c)
    return model, model.transform(cut.where("not is_train").drop("is_train"))


def retrain(rows: DataFrame, path: str, features: Sequence[str] = PREGAME, label: str = "win", date: str = "date", order: Sequence[str] = ("game", "team"), c: float = STRENGTH_C) -> WinModel:
    """The production job: the calibrated model of all rows, saved with its metadata (rows, last date, time) and read back."""
    train_calibrated(rows, features, label, date, order, c=c).save(rows.sparkSession, path)
    return WinModel.load(rows.sparkSession, path)


def cross_validate(rows: DataFrame, features: Sequence[str] = PREGAME, label: str = "win", date: str = "date", order: Sequence[str] = ("game", "team"), folds: int = 5, c: float = STRENGTH_C) -> DataFrame:
    """Metrics of each expanding temporal fold: fold, n_train, n, accuracy, auc, log_loss. All folds are fitted and scored together."""
    placed = temporal_folds(rows.dropna(subset=[*features, label]), date, order, folds).cache()
    fit, own = placed.where("role = 'train'"), F.array((F.col("fold") - 1).cast("int"))
    scales, sizes = scales_of(fit, features, own, folds)
    models = fit_many(fit, own, folds, standardised(features, scales, F.col("_m")), F.col(label), c)
    test = placed.where("role = 'test'").withColumn("_m", (F.col("fold") - 1).cast("int"))
    z = margin(standardised(features, scales, F.col("_m")), F.col("_m"), models)
    scored = test.select("fold", F.col(label).alias("win"), (1 / (1 + F.exp(-z))).alias("prob"))
    n_train = F.get(F.array(*map(F.lit, sizes)), (F.col("fold") - 1).cast("int"))
    return metrics(scored, "win", "prob", ["fold"]).withColumn("n_train", n_train)


def cv_summary(by_fold: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' metrics."""
    names = ("accuracy", "auc", "log_loss")
    return by_fold.agg(*(F.avg(m).alias(f"{m}_mean") for m in names), *(F.stddev_pop(m).alias(f"{m}_std") for m in names))


def team_state(rows: DataFrame, metrics_: Sequence[str], keys: Sequence[str] = KEYS, span: int = 10, parity_last: int | None = None) -> DataFrame:
    """Each team's state after its last game: form over its whole history (parity_last: only its last games), recent wins, last date.

    ``league_`` columns hold the league's means over all game rows (not over teams), for teams without values of their own.
    """
    own = [*keys, "team"]
    q = 1 - 2 / (span + 1)
    back = last_k(rows, own, ["date", "game"], parity_last or 1 << 30)
    weight = F.pow(F.lit(q), F.col("_back") - 1)
    mean = lambda m: F.try_divide(F.sum(F.col(m) * weight), F.sum(F.when(F.col(m).isNotNull(), weight)))
    state = back.groupBy(*own).agg(F.max("date").alias("last_date"), F.avg(F.when(F.col("_back") <= 5, F.col("win"))).alias("win_last5"), *(mean(m).alias(f"{m}_ewm") for m in metrics_))
    means = [F.avg("win").alias("league_win_last5"), *(F.avg(m).alias(f"league_{m}_ewm") for m in metrics_)]
    league = rows.groupBy(*keys).agg(*means) if keys else rows.agg(*means)
    return state.join(league, list(keys)) if keys else state.crossJoin(F.broadcast(league))  # one row


def fixture_features(fixture: DataFrame, state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fixture rows (home, away, date) with the home team's state and the rest of both; unknown teams go, missing values take the league's mean over game rows."""
    values = [c for c in state.columns if c not in (*keys, "team", "last_date") and not c.startswith("league_")]
    side = lambda name, cols: state.select(*keys, F.col("team").alias(name), F.col("last_date").alias(f"_{name}_last"), *cols)
    rows = fixture.join(side("home", [*values, *(f"league_{c}" for c in values)]), [*keys, "home"]).join(side("away", []), [*keys, "away"])
    rest = lambda name: F.greatest(F.datediff("date", F.col(f"_{name}_last")), F.lit(1))
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.col(f"league_{c}")) for c in values} | {"rest": rest("home"), "opp_rest": rest("away"), "is_home": F.lit(1)})
    return rows.withColumn("rest_diff", F.col("rest") - F.col("opp_rest")).drop(*(f"league_{c}" for c in values), "_home_last", "_away_last")


def predict_fixture(fixture: DataFrame, state: DataFrame, model: WinModel, keys: Sequence[str] = KEYS) -> DataFrame:
    """prob_local and prob_visit of every known pairing, three decimals, half-even, summing to 1."""
    rows = model.transform(fixture_features(fixture, state, keys).withColumnRenamed("is_home", "home_flag").withColumnRenamed("home", "local").withColumnRenamed("home_flag", "home"))
    p = F.bround("prob", 3)
    return rows.select(*keys, "date", "local", F.col("away").alias("visitante"), p.alias("prob_local"), F.bround(1 - p, 3).alias("prob_visit"))
