"""Complete jobs: incidents to panel, panel to grids, grids to models and forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.timing import add_calendar, anchored_bucket, month_start, week_start
from riskloom.operators.counts import TIME_COLUMN, aggregate_cells, cell_time, class_balance
from riskloom.operators.evaluation import (
    average_precision, best_f1, class_report, confusion, pr_curve, score_counts,
)
from riskloom.operators.features import (
    Features, align_features, select_features, time_split, undersample, valid_columns,
)
from riskloom.operators.forecast import forecast_frame, ranked_forecast
from riskloom.operators.grid import dense_grid, time_span
from riskloom.operators.models import STACK_FOLDS, RiskModel, fit_single, fit_stacked
from riskloom.operators.priors import PANEL_WINDOWS, ROLLUP_WINDOWS, add_priors
from riskloom.operators.rollup import rollup
from riskloom.schema import (
    COUNT, FREQUENCIES, HOURLY_PROTECTED, KEY, LABEL, SIDE_FEATURES, label, normalize_key, require,
)
from riskloom.session import materialize, release
from riskloom.sources.contracts import Contract
from riskloom.sources.readers import parsed_time, resolve_event_time
from riskloom.sources.writers import write_metrics, write_pr_curve, write_report


def labelled_panel(
    incidents: DataFrame,
    granularity: str = "daily",
    tz: str | None = None,
    side_cols: Iterable[str] = SIDE_FEATURES,
    span: tuple | None = None,
    windows: dict[str, int] = PANEL_WINDOWS,
    check: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Raw incidents to a dense, labelled grid with side features and priors.

    Counts and side features come from one aggregate over the incidents.  Only
    observed cells are shuffled (once by cell, once by area); gap filling,
    calendar and priors then run in place.  With ``check`` the job itself fails
    if no time can be parsed, where it looks for the span.
    """
    time_col = TIME_COLUMN[granularity]
    raw = resolve_event_time(normalize_key(incidents))
    if span is None:
        span = time_span(raw.select(cell_time(granularity).alias(time_col)), time_col, required=check)
        if check:
            # Evaluated before the incidents are read, even if no cell comes of them.
            raw = raw.filter(span[0].isNotNull())
    cells = aggregate_cells(raw, granularity, side_cols)
    grid = dense_grid(cells, time_col, span, (COUNT,), partitions).withColumn(LABEL, label(F.col(COUNT)))
    hourly = granularity == "hourly"
    grid = add_calendar(grid, time_col, tz, hourly=hourly)
    keys = ("day_of_week", "hour", "season") if hourly else ("day_of_week",)
    return add_priors(grid, windows, keys, time_col, unique_cells=True)


def normalize_daily(
    daily: DataFrame, windows: dict[str, int] = ROLLUP_WINDOWS, unique_cells: bool = False
) -> DataFrame:
    """A daily grid in standard form: label, UTC calendar and 28/180-day priors."""
    df = require(normalize_key(daily), [KEY, "t0", COUNT], "daily grid")
    df = parsed_time(df, "t0", strict=True).withColumn(LABEL, label(F.col(COUNT)))
    df = add_calendar(df, "t0", hour_start="zero")
    return add_priors(df, windows, time_col="t0", unique_cells=unique_cells).drop("t0_local")


def coarse_grid(daily: DataFrame, freq: str, windows: dict[str, int] = ROLLUP_WINDOWS) -> DataFrame:
    """A weekly or monthly grid; its 28/180-day priors are computed anew."""
    starts = {"1W": week_start, "1M": month_start}
    old = [f"prior_{kind}_{s}" for kind in ("cnt", "p") for s in windows]
    grid = rollup(daily.drop(*old), starts[freq](F.col("t0")))
    grid = add_calendar(grid, "t0", hour_start="zero")
    return add_priors(grid, windows, time_col="t0", unique_cells=True)


def frequency_grids(
    daily: DataFrame, freqs: Iterable[str] = FREQUENCIES, unique_cells: bool = False
) -> dict[str, DataFrame]:
    """The standard daily grid and the coarser ones made from it."""
    wanted = [f.strip().upper() for f in freqs if f.strip()]
    unknown = [f for f in wanted if f not in FREQUENCIES]
    if unknown:
        raise ValueError(f"unknown frequency {unknown}; allowed: {FREQUENCIES}")
    standard = normalize_daily(daily, unique_cells=unique_cells)
    if len(set(wanted)) > 1:
        # The dense daily grid is what costs most: made once, read for each frequency.
        standard = materialize(standard)
    return {f: standard if f == "1D" else coarse_grid(standard, f) for f in wanted}


def window_grid(
    hourly: DataFrame,
    freq: str,
    as_of: datetime,
    tz: str | None = None,
    prior_mode: str = "closed_left",
    utc_calendar: bool = False,
    contract: Contract | None = None,
) -> DataFrame:
    """An hourly grid to local days, or to 7/30-day blocks counted from the run day.

    The calendar follows the local bucket start unless ``utc_calendar``.  A
    ``contract`` counts bad times and keys as the grid is read: enforce it
    when the result has been written.
    """
    if contract is not None:
        hourly = contract.watch(hourly)
    df = require(normalize_key(hourly), [KEY, "dt", COUNT], "hourly grid").drop("dt_local")
    df = parsed_time(df, "dt")
    start = anchored_bucket(F.col("dt"), freq, as_of, tz)
    grid = rollup(df, start, HOURLY_PROTECTED, group_extra=("block_id",))
    grid = add_calendar(grid, "t0", None if utc_calendar else tz, hour_start="clock", keep_local=False)
    return add_priors(grid, ROLLUP_WINDOWS, unique_cells="block_id" not in grid.columns, mode=prior_mode)


def training_parts(
    grid: DataFrame, share: float = 0.8, on_leak: str = "drop"
) -> tuple[DataFrame, DataFrame, Features]:
    """Time split, and the features that vary within the training part."""
    require(grid, [KEY, "t0", LABEL], "training grid")
    if grid.schema["t0"].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date"):
        grid = parsed_time(grid, "t0")
    if not {"year", "month", "day_of_week"} <= set(grid.columns):
        made = add_calendar(grid, "t0")
        grid = made.select(*grid.columns, *[c for c in ("year", "month", "day_of_week") if c not in grid.columns])
    chosen = select_features(grid, on_leak)
    train, test = time_split(grid, share)
    numeric = valid_columns(train, chosen.numeric) if on_leak == "drop" else chosen.numeric
    features = Features(numeric, chosen.categorical)
    if not features.all:
        raise ValueError("no usable feature left")
    return train, test, features


def evaluate(scored: DataFrame, y: str = LABEL, p: str = "prob") -> DataFrame:
    """One row of test metrics from a scored set.

    The scores are reduced to one row per distinct value once; the measures
    are one-row results that enter the metrics row as literals.
    """
    counts = materialize(score_counts(scored, y, p))
    best = best_f1(counts).first()
    facts = average_precision(counts).first().asDict()
    facts["pr_auc"] = facts.pop("average_precision")
    facts |= best.asDict()
    facts |= confusion(scored, float(best["best_threshold"]), y, p).first().asDict()
    release(counts)
    balance = class_balance(scored, y).first()
    facts |= {"y1_count": balance["pos"], "y0_count": balance["neg"], "y1_rate": balance["y1_rate"]}
    return scored.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])


def weighted_sample(train_part: DataFrame, ratio: float, weight_after_sampling: bool = False) -> tuple[DataFrame, Row]:
    """The undersampled training part, and the class balance that weights it: of the whole part, or of what is left."""
    sampled = undersample(train_part, ratio, at_least_one=not weight_after_sampling)
    return sampled, class_balance(sampled if weight_after_sampling else train_part).first()


def train(
    grid: DataFrame,
    freq: str,
    kind: str = "single",
    undersample_ratio: float = 0.0,
    weight_after_sampling: bool = False,
    on_leak: str = "drop",
    share: float = 0.8,
    sizes: dict | None = None,
    folds: int = STACK_FOLDS,
) -> tuple[RiskModel, DataFrame, DataFrame]:
    """Fit one frequency; returns model, metrics row and the scored test set."""
    if kind not in ("single", "stacked"):
        raise ValueError(f"kind must be single or stacked, not {kind!r}")
    train_part, test_part, features = training_parts(grid, share, on_leak)
    columns = [KEY, "t0", LABEL, *features.all]
    train_part = materialize(train_part.select(*[F.col(f"`{c}`") for c in columns]))
    try:
        sampled, balance = weighted_sample(train_part, undersample_ratio, weight_after_sampling)
        if kind == "stacked":
            model = fit_stacked(sampled, features, folds=folds, sizes=sizes)
        else:
            model = fit_single(sampled, features, balance["scale_pos_weight"], **(sizes or {}))
        n_train = sampled.count()
    finally:
        release(train_part)
    scored = materialize(
        model.score(test_part.select(*[F.col(f"`{c}`") for c in columns])).select(KEY, "t0", LABEL, "prob")
    )
    facts = {
        "freq": F.lit(freq), "model_type": F.lit(kind), "n_train": F.lit(n_train), "n_test": F.lit(scored.count()),
        "n_features_num": F.lit(len(features.numeric)), "n_features_cat": F.lit(len(features.categorical)),
        "features_num": F.array(*[F.lit(c) for c in features.numeric]).cast("array<string>"),
        "features_cat": F.array(*[F.lit(c) for c in features.categorical]).cast("array<string>"),
        "train_pos": F.lit(balance["pos"]), "train_neg": F.lit(balance["neg"]),
        "scale_pos_weight": F.lit(balance["scale_pos_weight"]), "undersample_neg_train": F.lit(float(undersample_ratio)),
    }
    return model, evaluate(scored).withColumns(facts), scored


def train_frequencies(
    grids: dict[str, DataFrame],
    keep_going: bool = False,
    on_done: Callable[[str, RiskModel, DataFrame, DataFrame], None] | None = None,
    **options,
) -> tuple[dict[str, RiskModel], dict[str, Exception]]:
    """Train every frequency that has a grid; ``keep_going`` collects failures instead of raising."""
    models: dict[str, RiskModel] = {}
    failed: dict[str, Exception] = {}
    for freq, grid in grids.items():
        if grid is None:
            continue
        try:
            model, metrics, scored = train(grid, freq, **options)
            models[freq] = model
            if on_done:
                on_done(freq, model, metrics, scored)
        except Exception as error:
            if not keep_going:
                raise
            failed[freq] = error
    return models, failed


def train_outcomes(
    grids: dict[str, DataFrame | None], on_done: Callable[[str, RiskModel, DataFrame, DataFrame], None] | None = None, **options
) -> tuple[dict[str, RiskModel], DataFrame]:
    """Train every frequency; models, and a row for each: ``freq, outcome, reason, n_train, n_test``.

    ``outcome`` is trained, skipped (no grid) or failed; a failure, of
    ``on_done`` too, stops no other frequency and ``reason`` tells its kind and
    first line.
    """
    models: dict[str, RiskModel] = {}
    rows: list[tuple] = []
    for freq, grid in grids.items():
        if grid is None:
            rows.append((freq, "skipped", "no grid", None, None))
            continue
        sizes: dict[str, int] = {}

        def told(freq, model, metrics, scored):
            sizes.update(metrics.select("n_train", "n_test").first().asDict())
            if on_done:
                on_done(freq, model, metrics, scored)

        done, failed = train_frequencies({freq: grid}, keep_going=True, on_done=told, **options)
        if freq in failed:
            error = failed[freq]
            rows.append((freq, "failed", f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}", None, None))
        else:
            models |= done
            rows.append((freq, "trained", None, sizes["n_train"], sizes["n_test"]))
    spark = SparkSession.getActiveSession()
    return models, spark.createDataFrame(rows, "freq string, outcome string, reason string, n_train long, n_test long")


def save_run(root: str, freq: str, model: RiskModel, metrics: DataFrame, scored: DataFrame) -> None:
    """Model, metrics row, precision-recall curve and class report of one training run."""
    kind = "stacked" if model.bases else "single"
    name = f"{kind}_{freq.lower()}"
    model.save(f"{root}/models/{name}")
    metrics = materialize(metrics)
    write_metrics(metrics, f"{root}/reports/metrics")
    counts = score_counts(scored, LABEL, "prob")
    write_pr_curve(pr_curve(counts), f"{root}/reports/pr_curve_{name}")
    threshold = float(metrics.first()["best_threshold"])
    write_report(class_report(confusion(scored, threshold, LABEL, "prob")), f"{root}/reports/class_report_{name}")


def score_frame(model: RiskModel, frame: DataFrame) -> DataFrame:
    """Score a forecast frame: align its columns to the model and keep (area, time, prob)."""
    return model.score(align_features(frame, model.inputs, keep=(KEY, "t0"))).select(KEY, "t0", "prob")


def forecast(
    model: RiskModel,
    grid: DataFrame,
    freq: str,
    hours: float,
    as_of: datetime,
    area: str | None = None,
    k: int | None = 50,
    dense: bool = False,
) -> DataFrame:
    """Ranked and tiered forecast for all areas, or for one.

    Scores are written once: the tier limits and the ranking both read them.
    """
    frame = forecast_frame(grid, freq, hours, as_of, area, dense=dense)
    return ranked_forecast(materialize(score_frame(model, frame)), k, area)
