"""Detection quality, monitoring counters, history queries and data splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions.features import is_normal
from flowwarden.operators.slices import hash_rank, running_totals

TICKS = 60


def _guarded(num: Column, den: Column) -> Column:
    return num / F.greatest(den, F.lit(1))


def attack_truth() -> Column:
    return ~is_normal(F.col("label"))


def confusion(outcomes: DataFrame) -> DataFrame:
    """Counts over flows with `label` and `fired`."""
    truth, fired = attack_truth(), F.col("fired")
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if(fired).alias("alerts"),
        F.count_if(truth & fired).alias("tp"),
        F.count_if(~truth & fired).alias("fp"),
        F.count_if(truth & ~fired).alias("fn"),
        F.count_if(~truth & ~fired).alias("tn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "tpr": _guarded(tp, tp + fn),
            "fpr": _guarded(fp, fp + tn),
            "precision": _guarded(tp, tp + fp),
            "accuracy": _guarded(tp + tn, tp + fp + fn + tn),
        }
    ).withColumn(
        "f1",
        2 * F.col("precision") * F.col("tpr")
        / F.greatest(F.col("precision") + F.col("tpr"), F.lit(1e-9)),
    )


def breakdown(alert_rows: DataFrame) -> DataFrame:
    """Alert counts by severity, by attack class and by action, in one aggregation."""
    dims = ["severity", "attack_type", "action"]
    typed = alert_rows.select(*[F.col(d).cast("string").alias(d) for d in dims])
    grouped = typed.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n")
    )
    return grouped.select(
        F.when(F.col("g") == 3, "severity")
        .when(F.col("g") == 5, "attack_type")
        .otherwise("action")
        .alias("dimension"),
        F.coalesce(*dims).alias("value"),
        "n",
    )


def snapshot_json(outcomes: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Counters, rates (four places), breakdowns, the timeline of the newest ticks and the flows
    of the last second as one JSON document."""
    nested = (
        breakdown(alert_rows)
        .groupBy("dimension")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("m"))
        .agg(F.map_from_entries(F.collect_list(F.struct("dimension", "m"))).alias("maps"))
    ).scalar()
    tick = F.struct("tick_us", "alerts", "total", "tpr")  # at most TICKS of them
    line = timeline(outcomes).agg(F.array_sort(F.collect_list(tick))).scalar()
    last = throughput(outcomes).agg(F.max_by("flows_per_sec", "tick_us")).scalar()
    row = rates(confusion(outcomes)).withColumns(
        {"maps": nested, "timeline": line, "flows_per_sec": F.round(last, 1)}
    )
    rounded = [F.round(c, 4).alias(c) for c in ("tpr", "fpr", "precision", "f1")]
    maps = [
        F.col("maps")[d].alias(k)
        for d, k in (
            ("severity", "by_severity"),
            ("attack_type", "by_attack"),
            ("action", "by_action"),
        )
    ]
    counts = ["total", "alerts", "tp", "fp", "fn", "tn"]
    return row.select(
        F.to_json(F.struct(*counts, *rounded, *maps, "timeline", "flows_per_sec")).alias("snapshot")
    )


def per_tick(outcomes: DataFrame, seconds: int = 1) -> DataFrame:
    width = seconds * 1_000_000
    truth, fired = attack_truth(), F.col("fired")
    return outcomes.groupBy(
        (F.col("ts_us") - F.pmod("ts_us", F.lit(width))).alias("tick_us")
    ).agg(
        F.count("*").alias("total"),
        F.count_if(fired).alias("alerts"),
        F.count_if(truth & fired).alias("tp"),
        F.count_if(truth & ~fired).alias("fn"),
    )


def throughput(outcomes: DataFrame, seconds: int = 1) -> DataFrame:
    return per_tick(outcomes, seconds).select(
        "tick_us", (F.col("total") / seconds).alias("flows_per_sec")
    )


def timeline(outcomes: DataFrame, seconds: int = 1, keep: int = TICKS) -> DataFrame:
    """Cumulative alerts, flows and TPR at each of the newest `keep` ticks.

    Totals of the older ticks enter as one row, so only `keep` + 1 rows are ordered.
    """
    ticks = per_tick(outcomes, seconds)
    names = ["total", "alerts", "tp", "fn"]
    newest = ticks.orderBy(F.col("tick_us").desc()).limit(keep)
    first = newest.agg(F.min("tick_us")).scalar()
    older = ticks.where(F.col("tick_us") < first).agg(
        F.lit(None).cast("bigint").alias("tick_us"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )
    upto = Window.orderBy(F.col("tick_us").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        newest.unionByName(older)
        .select("tick_us", *[F.sum(n).over(upto).alias(n) for n in names])
        .where(F.col("tick_us").isNotNull())
        .select(
            "tick_us",
            "alerts",
            "total",
            F.round(_guarded(F.col("tp"), F.col("tp") + F.col("fn")), 3).alias("tpr"),
        )
    )


def tick_deltas(ticks: DataFrame) -> DataFrame:
    """Share of new flows that raised an alert, between neighbouring ticks."""
    order = Window.orderBy("tick_us")  # at most `keep` rows
    more = F.col("alerts") - F.lag("alerts").over(order)
    seen = F.col("total") - F.lag("total").over(order)
    return ticks.select(
        "tick_us",
        F.coalesce(F.greatest(F.lit(0.0), _guarded(more, seen)), F.lit(0.0)).alias("delta"),
    )


def latest_alerts(events: DataFrame, n: int = 50) -> DataFrame:
    """The newest n alerts in time order, with their position."""
    newest = events.orderBy(F.col("ts_us").desc(), F.col("uid").desc()).limit(n)
    return newest.withColumn(
        "position", F.row_number().over(Window.orderBy("ts_us", "uid"))
    )


def running_rates(outcomes: DataFrame) -> DataFrame:
    """Policy inputs at each alert: rates over all flows before it, and its own scores."""
    truth, fired = attack_truth(), F.col("fired")
    marks = {
        "n": F.lit(1),
        "a": fired.cast("int"),
        "tp": (truth & fired).cast("int"),
        "fn": (truth & ~fired).cast("int"),
        "fp": (~truth & fired).cast("int"),
        "tn": (~truth & ~fired).cast("int"),
    }
    sums = running_totals(outcomes, "ts_us", "uid", marks)
    return sums.where("fired").select(
        "uid",
        F.least(_guarded(F.col("a"), F.col("n")), F.lit(1.0)).alias("alert_rate"),
        _guarded(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
        _guarded(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        F.lit(0.9).alias("service_level"),
        F.lit(0.0).alias("reserved"),
        "confidence",
        "score",
        F.when(F.col("severity") == 4, 1.0).otherwise(0.0).alias("is_critical"),
    )


def event_history(
    events: DataFrame,
    event_type: str | None = None,
    since_us: int = 0,
    limit: int = 100,
    keep: int | None = None,
) -> DataFrame:
    """Newest `limit` matching events; with `keep`, only of the newest that are retained."""
    newest_first = [F.col("ts_us").desc(), F.col("event_id").desc()]
    found = events if keep is None else events.orderBy(*newest_first).limit(keep)
    if event_type:
        found = found.where(F.col("type") == event_type)
    if since_us:
        found = found.where(F.col("ts_us") >= since_us)
    return found.orderBy(*newest_first).limit(limit)


def bus_events(decided: DataFrame) -> DataFrame:
    """One event per alert and one per successful action, from the decided alerts."""
    raised = F.struct(
        F.lit("alert_generated").alias("type"),
        F.lit("ids_pipeline").alias("source"),
        F.concat("uid", F.lit("/0")).alias("event_id"),
    )
    acted = F.struct(
        F.lit("mitigation_applied").alias("type"),
        F.lit("mitigation_engine").alias("source"),
        F.concat("uid", F.lit("/1")).alias("event_id"),
    )
    both = F.array_compact(F.array(raised, F.when(F.col("success"), acted)))
    return decided.select("ts_us", "uid", F.inline(both))


def action_frequency(alert_rows: DataFrame) -> DataFrame:
    return alert_rows.groupBy("action").agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), "action"
    )


# ---- classification report, splits and class shares ----


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted averages.

    `predictions` has the columns label and predicted.
    """
    cells = predictions.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("label") == F.col("predicted")
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("predicted").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("tp"),
                ),
            )
        )
    )
    def over(den: str) -> Column:
        return F.when(F.col(den) > 0, F.col("tp") / F.col(den)).otherwise(0.0)

    per_class = (
        sides.groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
        .withColumns({"precision": over("predicted"), "recall": over("support")})
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"),
                    F.col("precision") + F.col("recall"),
                ),
                F.lit(0.0),
            ),
        )
    )
    scores = ["precision", "recall", "f1"]
    macro = per_class.agg(
        F.lit("macro avg").alias("class"),
        *[F.avg(s).alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    weighted = per_class.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    share = F.sum("tp") / F.sum("support")
    accuracy = per_class.agg(
        F.lit("accuracy").alias("class"),
        *[share.alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    columns = ["class", *scores, "support"]
    return per_class.select(columns).unionByName(macro).unionByName(weighted).unionByName(accuracy)


def shuffled_split(df: DataFrame, test_share: float, key: str = "uid") -> DataFrame:
    """Add `part`: exactly floor(n * (1 - test_share)) rows in hash order are train."""
    n = df.count()
    train = int(n * (1 - test_share))
    ranked = hash_rank(df, key, name="_rank")
    return ranked.withColumn(
        "part", F.when(F.col("_rank") <= train, "train").otherwise("test")
    ).drop("_rank")


def warm_up(flows: DataFrame, wanted: int = 200) -> DataFrame:
    """The earliest min(wanted, n // 2) flows."""
    size = min(wanted, flows.count() // 2)
    return flows.orderBy("ts_us", "uid").limit(size)


def class_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per class
    return counts.select("label", "n", (100.0 * F.col("n") / total).alias("percent"))
