"""Evidence fusion: points per item, diminishing returns, category caps, case score.

Input is the ``evidence`` table: case_id, item_seq (order of emission, unique in a case),
module, signal, category, status, severity, confidence, quality, available,
correlation_group, is_positive.

Diminishing returns only treat the three strongest items of a correlation group specially;
all others share one tail factor. A case total is therefore the sum of every item at its
tail weight plus a correction for at most three items per group. Both parts aggregate
before the shuffle, so a case holding a third of all evidence needs no large window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import dims
from attestry.dims import DEFAULT_RISK, RiskConfig
from attestry.functions.text import case_when
from attestry.operators import conflicts
from attestry.operators.ranking import HOT_ROWS, first_row, split_hot, spread_ordinal, top_rows

GROUP = ["case_id", "category", "correlation_group"]
DIGITS = 8  # absorbs the order in which doubles were summed


def rounded(column: Column, digits: int) -> Column:
    """Half-up rounding that treats 5.0149999999999997 as the 5.015 it stands for."""
    return F.round(F.round(column, DIGITS), digits)


def confidence_factor(confidence: Column, config: RiskConfig = DEFAULT_RISK) -> Column:
    steps = [(confidence >= low, F.lit(factor)) for low, factor in config.confidence_steps]
    return case_when(steps, F.lit(config.confidence_floor))


def quality_factor(quality: Column) -> Column:
    return F.when(quality < 0.99, 0.5 + 0.5 * quality).otherwise(1.0)


def is_uncertain(config: RiskConfig = DEFAULT_RISK) -> Column:
    return F.col("severity").isin("HIGH", "CRITICAL") & (F.col("confidence") < config.uncertain_below)


def score_items(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Adds base points, their weights and ``tail_effect``, the effect outside the lead ranks."""
    points = F.broadcast(dims.points_frame(evidence.sparkSession))
    fallback = case_when(
        [(F.col("severity") == level, F.lit(value)) for level, value in dims.DEFAULT_POINTS.items()], F.lit(0.0)
    )
    scored = (F.col("severity") != "NONE") & F.col("available")
    tail = F.when(F.col("correlation_group").isNull(), 1.0).otherwise(config.tail_factor)
    return (
        evidence.join(points, ["signal", "severity"], "left")
        .withColumn("base", F.when(scored, F.coalesce("points", fallback)).otherwise(0.0))
        .withColumn("confidence_factor", confidence_factor(F.col("confidence"), config))
        .withColumn("quality_factor", quality_factor(F.col("quality")))
        .withColumn("tail_effect", F.col("base") * tail * F.col("confidence_factor") * F.col("quality_factor"))
        .drop("points")
    )


def leading_items(items: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """The strongest items of each correlation group with their true ``effect``."""
    factors = config.rank_factors
    lead = top_rows(
        items.filter(F.col("available") & F.col("correlation_group").isNotNull()),
        GROUP,
        [F.desc("base"), F.asc("item_seq")],
        len(factors),
        "group_rank",
    )
    factor = case_when([(F.col("group_rank") == i + 1, F.lit(f)) for i, f in enumerate(factors)])
    return lead.withColumn("effect", F.col("base") * factor * F.col("confidence_factor") * F.col("quality_factor"))


def _raw(category: str) -> str:
    return "raw_" + category.lower()


def _counts() -> list[Column]:
    """Module states and evidence counts of a case; ``item`` marks the rows that are evidence."""

    def count(condition):
        return F.count(F.when(condition & F.col("item").isNotNull(), 1))

    states = []
    for m in [*dims.MODULES, dims.OPTIONAL_MODULE]:
        states += [
            count((F.col("module") == m) & F.col("available")).alias(f"{m}_seen"),
            count((F.col("module") == m) & ~F.col("available")).alias(f"{m}_lost"),
        ]
    return [
        *states,
        F.count("item").alias("total_evaluated"),
        count(F.col("available")).alias("available_count"),
        count(~F.col("available")).alias("unavailable_count"),
        count(F.col("available") & (F.col("severity") != "NONE")).alias("adverse_count"),
        count(F.col("available") & F.col("is_positive")).alias("positive_count"),
        count(F.col("uncertain")).alias("uncertainty_count"),
    ]


def case_counts(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Counts per case alone: one scan, one pre-aggregated shuffle."""
    rows = evidence.withColumns({"item": F.lit(1), "uncertain": is_uncertain(config)})
    return rows.groupBy("case_id").agg(*_counts())


def case_rollup(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """One row per case: raw category sums, override target, counts, module states.

    Everything the scoring queries need comes out of this one aggregation.
    """
    items = score_items(evidence, config)
    available, signal = F.col("available"), F.col("signal")
    target = case_when(
        [
            (available & (signal == "registry_revoked") & (F.col("status") == "REVOKED"), F.lit(config.revoked_target)),
            (
                available & (signal == "presentation_attack_detected") & (F.col("severity") == "CRITICAL"),
                F.lit(config.spoof_target),
            ),
            (available & (signal == "qr_crypto_invalid"), F.lit(config.signature_target)),
        ]
    )
    whole = items.select(
        "case_id", "category", F.col("tail_effect").alias("points"), "module", "available", "severity", "is_positive",
        target.alias("target"), is_uncertain(config).alias("uncertain"), F.lit(1).alias("item"),
    )
    lead = leading_items(items, config).select(
        "case_id", "category", (F.col("effect") - F.col("tail_effect")).alias("points")
    )
    rows = whole.unionByName(lead, allowMissingColumns=True)

    sums = [
        F.sum(F.when(F.col("category") == c, F.col("points")).otherwise(0.0)).alias(_raw(c)) for c in config.caps
    ]
    return rows.groupBy("case_id").agg(*sums, F.max("target").alias("override_target"), *_counts())


def _capped(category: str, cap: float) -> Column:
    return F.least(F.round(_raw(category), DIGITS), F.lit(cap))


def total_score(config: RiskConfig = DEFAULT_RISK) -> Column:
    """Half-even rounded sum of the capped categories, at most 100."""
    total = sum((_capped(c, cap) for c, cap in config.caps.items()), F.lit(0.0))
    return F.least(F.bround(F.round(total, DIGITS), 0), F.lit(100.0)).cast("int")


def risk_level(score: Column, config: RiskConfig = DEFAULT_RISK) -> Column:
    return case_when([(score >= low, F.lit(level)) for low, level in config.levels], F.lit("LOW"))


def recommendation(level: Column) -> Column:
    return case_when([(level == k, F.lit(v)) for k, v in dims.RECOMMENDATIONS.items()])


def completeness() -> Column:
    """(completed + half of partial) / expected modules, from the roll-up's module states."""
    def worth(m):
        return case_when(
            [
                ((F.col(f"{m}_seen") > 0) & (F.col(f"{m}_lost") > 0), F.lit(0.5)),
                (F.col(f"{m}_seen") > 0, F.lit(1.0)),
            ],
            F.lit(0.0),
        )

    optional = dims.OPTIONAL_MODULE
    expected = len(dims.MODULES) + F.when(F.col(f"{optional}_seen") + F.col(f"{optional}_lost") > 0, 1).otherwise(0)
    got = sum((worth(m) for m in [*dims.MODULES, optional]), F.lit(0.0))
    return F.round(F.least(F.lit(1.0), got / expected), 3)


def risk_score(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Score, level and advice per case, without policy overrides."""
    scored = case_rollup(evidence, config).withColumn("risk_score", total_score(config))
    scored = scored.withColumn("risk_level", risk_level(F.col("risk_score"), config))
    return scored.select(
        "case_id", "risk_score", "risk_level", recommendation(F.col("risk_level")).alias("officer_recommendation"),
        F.lit(config.version).alias("risk_config_version"),
    )


def category_breakdown(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Every category of every case, empty ones included, with its share of the cap."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                F.round(_raw(c), DIGITS).alias("raw"),
                _capped(c, cap).alias("capped"),
                F.lit(cap).alias("maximum"),
            )
            for c, cap in config.caps.items()
        ]
    )
    rows = case_rollup(evidence, config).select("case_id", F.explode(cells).alias("c")).select("case_id", "c.*")
    return rows.select(
        "case_id", "category",
        F.round("raw", 4).alias("raw_contribution"),
        F.round("capped", 2).alias("contribution"),
        "maximum",
        rounded(F.col("capped") / F.col("maximum") * 100, 1).alias("percentage_of_max"),
    )


def risk_override(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Score raised to the strongest override target; level may be INCONCLUSIVE."""
    target = F.coalesce("override_target", F.lit(0))
    rows = (
        case_rollup(evidence, config)
        .withColumn("base_score", total_score(config))
        .withColumn("risk_score", F.greatest("base_score", target))
        .withColumn("critical_override_applied", F.col("base_score") < target)
        .withColumn("completeness", completeness())
    )
    reduced = F.round(F.col("completeness") - 0.05 * F.col("uncertainty_count"), 3)
    rows = rows.withColumn(
        "assessment_confidence",
        F.when(F.col("completeness") == 0.0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduced))),
    )
    unclear = (F.col("assessment_confidence") < 0.20) & (F.col("risk_score") < 50)
    level = F.when(unclear, "INCONCLUSIVE").otherwise(risk_level(F.col("risk_score"), config))
    return rows.withColumn("risk_level", level).select(
        "case_id", "base_score", "risk_score", "critical_override_applied", "completeness",
        "assessment_confidence", "risk_level", recommendation(F.col("risk_level")).alias("officer_recommendation"),
    )


def module_completeness(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """State of each expected module of each case and the case's completeness."""
    def state(m):
        seen, lost = F.col(f"{m}_seen") > 0, F.col(f"{m}_lost") > 0
        return case_when(
            [(seen & lost, F.lit("partial")), (seen, F.lit("completed")), (lost, F.lit("unavailable"))],
            F.lit("not_run"),
        )

    modules = [*dims.MODULES, dims.OPTIONAL_MODULE]
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("module"), state(m).alias("status"), F.col(f"{m}_seen").alias("evidence_count"))
            for m in modules
        ]
    )
    rows = case_counts(evidence, config).select(
        "case_id", completeness().alias("completeness"), F.explode(cells).alias("m")
    )
    expected = F.col("m.module").isin(dims.MODULES) | (F.col("m.status") != "not_run")
    return rows.filter(expected).select("case_id", "m.*", "completeness")


def evidence_summary(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Counts of evidence, conflicts and contradictions per case from one aggregation."""
    rows = evidence.withColumns({"item": F.lit(1), "uncertain": is_uncertain(config)})
    facts = [c.alias(n) for n, c in conflicts.facts().items()]
    return conflicts.with_patterns(rows.groupBy("case_id").agg(*_counts(), *facts)).select(
        "case_id", "total_evaluated", "available_count", "unavailable_count", "adverse_count", "positive_count",
        "uncertainty_count", conflicts.conflict_count().cast("long").alias("conflict_count"),
        conflicts.contradiction_count().alias("contradiction_count"),
    )


def _category_position() -> Column:
    return case_when([(F.col("category") == c, F.lit(i)) for i, c in enumerate(dims.CATEGORY_CAPS)], F.lit(99))


def contribution_order() -> list[Column]:
    return [
        F.desc("effect"), F.asc("_category"), F.asc("_ungrouped"), F.asc("_group_start"), F.desc("_strength"),
        F.asc("item_seq"),
    ]


def _with_order(items: DataFrame, starts: DataFrame) -> DataFrame:
    """Columns that break ties between equal effects: category, group, strength, emission."""
    return _with_ties(items.join(starts, GROUP, "left"))


def _with_ties(items: DataFrame) -> DataFrame:
    return (
        items.withColumn("_category", _category_position())
        .withColumn("_ungrouped", F.col("correlation_group").isNull())
        .withColumn("_strength", F.when(F.col("correlation_group").isNotNull(), F.col("base")))
    )


def _group_starts(items: DataFrame) -> DataFrame:
    return (
        items.filter(F.col("available") & F.col("correlation_group").isNotNull())
        .groupBy(*GROUP)
        .agg(F.min("item_seq").alias("_group_start"))
    )


def effects(items: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    """Every scored item with its final ``effect``; joined on the unique item, so never skewed."""
    lead = leading_items(items, config).select("case_id", "item_seq", F.col("effect").alias("_lead"))
    return (
        items.join(lead, ["case_id", "item_seq"], "left")
        .withColumn("effect", F.coalesce("_lead", "tail_effect"))
        .drop("_lead")
    )


def _usual_effects(items: DataFrame, config: RiskConfig, shown: list[str]) -> DataFrame:
    """Items with an ``effect`` above zero, of cases whose rows one task may sort: one shuffle by case, all windows inside it.

    Items of base 0 have no effect and rank behind all others, so they only count for the start of their group and travel
    without what is shown of an item.
    """
    counts = F.col("base") > 0
    carried = [F.when(counts, F.col(c)).alias(c) for c in (*shown, "confidence_factor", "quality_factor")]
    rows = items.filter("available").select(*GROUP, "item_seq", "base", *carried).repartition("case_id")
    group = Window.partitionBy(*GROUP)
    strongest = F.row_number().over(group.orderBy(F.desc("base"), F.asc("item_seq")))
    rows = rows.withColumn("group_rank", strongest).withColumn("_group_start", F.min("item_seq").over(group))
    grouped = F.col("correlation_group").isNotNull()
    factors = [(F.col("group_rank") == i + 1, F.lit(f)) for i, f in enumerate(config.rank_factors)]
    factor = F.when(grouped, case_when(factors, F.lit(config.tail_factor))).otherwise(F.lit(1.0))
    effect = F.col("base") * factor * F.col("confidence_factor") * F.col("quality_factor")
    rows = rows.withColumn("effect", effect).filter(counts & (F.col("effect") > 0))
    return _with_ties(rows.withColumn("_group_start", F.when(grouped, F.col("_group_start"))))


def _top_of_any(items: DataFrame, config: RiskConfig, k: int) -> DataFrame:
    """The ``k`` strongest items of cases of any size.

    Only items that can reach the list are ranked: group leaders, the best of each group's
    tail (``k`` plus the leaders that may be among them) and the best ungrouped items.
    """
    lead = leading_items(items, config).drop("group_rank")
    grouped = F.col("correlation_group").isNotNull()
    strongest = [F.desc("tail_effect"), F.desc("base"), F.asc("item_seq")]
    tail = top_rows(items.filter(F.col("available") & grouped), GROUP, strongest, k + len(config.rank_factors))
    tail = tail.join(lead.select("case_id", "item_seq"), ["case_id", "item_seq"], "left_anti")
    single = top_rows(
        items.filter(F.col("available") & ~grouped), ["case_id", "category"],
        [F.desc("tail_effect"), F.asc("item_seq")], k,
    )
    rest = tail.unionByName(single).drop("rank").withColumn("effect", F.col("tail_effect"))
    candidates = lead.unionByName(rest).filter(F.col("effect") > 0)
    return top_rows(_with_order(candidates, _group_starts(items)), ["case_id"], contribution_order(), k, "position")


def top_contributors(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK, k: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ``k`` strongest items per case.

    Cases of more than ``hot_rows`` rows, of which there are few, are cut before every shuffle; all others meet in one.
    """
    hot, usual, large = split_hot(evidence, ["case_id"], hot_rows)
    rows = _usual_effects(score_items(usual, config), config, ["module", "signal", "severity"])
    ranked = top_rows(rows, ["case_id"], contribution_order(), k, "position")
    shown = ["case_id", "position", "item_seq", "module", "signal", "severity", rounded(F.col("effect"), 4).alias("contribution")]
    found = ranked.select(*shown)
    return found.unionByName(_top_of_any(score_items(large, config), config, k).select(*shown)) if hot else found


def risk_reasons(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every contributing item of a case, strongest first, with its ``R-<module>-NNN`` id."""
    hot, usual, large = split_hot(evidence, ["case_id"], hot_rows)
    needed = ["case_id", "item_seq", "module", "signal", "severity", "confidence", "effect", "position"]
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(*contribution_order())).cast("long")
    rows = _usual_effects(score_items(usual, config), config, ["module", "signal", "severity", "confidence"])
    rows = rows.withColumn("position", place).select(*needed)
    if hot:
        items = score_items(large, config)
        spread = effects(items, config).filter((F.col("effect") > 0) & (F.col("severity") != "NONE"))
        spread = spread_ordinal(_with_order(spread, _group_starts(items)), ["case_id"], contribution_order(), "position")
        rows = rows.unionByName(spread.select(*needed))
    number = F.lpad(
        F.col("position").cast("string"), F.greatest(F.length(F.col("position").cast("string")), F.lit(3)), F.lit("0")
    )
    return rows.select(
        "case_id", F.concat_ws("-", F.lit("R"), "module", number).alias("reason_id"), "position", "module", "signal",
        "severity", F.round("confidence", 3).alias("confidence"), rounded(F.col("effect"), 4).alias("contribution"),
    )


def uncertainties(evidence: DataFrame, config: RiskConfig = DEFAULT_RISK) -> DataFrame:
    return evidence.filter(is_uncertain(config)).select(
        "case_id", "item_seq", "module", "signal", "severity", "confidence"
    )


def supporting_evidence(evidence: DataFrame) -> DataFrame:
    """First positive or neutral item per signal of a case."""
    positive = F.col("available") & (F.col("is_positive") | (F.col("severity") == "NONE"))
    first = first_row(evidence.filter(positive), ["case_id", "signal"], [F.asc("item_seq")])
    return first.select(
        "case_id", F.lit("SUPPORTING").alias("kind"), "module", "signal", "item_seq",
        F.when(F.col("status") == "MATCH", "CORROBORATED").otherwise("PASS").alias("value"),
    )


def limitations(evidence: DataFrame) -> DataFrame:
    """First unavailable or inconclusive item per module and signal of a case."""
    open_item = ~F.col("available") | F.col("status").isin("UNAVAILABLE", "NOT_RUN", "INCONCLUSIVE")
    first = first_row(evidence.filter(open_item), ["case_id", "module", "signal"], [F.asc("item_seq")])
    impact = case_when(
        [(F.col("module").isin("M1", "M2"), F.lit("HIGH")), (F.col("module").isin("M4", "M5"), F.lit("MEDIUM"))],
        F.lit("LOW"),
    )
    return first.select(
        "case_id", F.lit("LIMITATION").alias("kind"), "module", "signal", "item_seq", impact.alias("value")
    )


def first_per_signal(evidence: DataFrame) -> DataFrame:
    return supporting_evidence(evidence).unionByName(limitations(evidence))
