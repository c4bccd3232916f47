"""Operators by name with the kinds of columns they take, and recommendations for a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import capability, describe, inference, msa, multivariate, nonparametric, regression, reliability, spc, timeseries


@dataclass(frozen=True)
class Command:
    """An operator, how many numeric and categorical columns it needs, and the intents it serves."""

    function: object
    numeric: int
    categorical: int
    intents: tuple[str, ...]


COMMANDS = {
    "descriptive": Command(describe.descriptive, 1, 0, ("explore",)),
    "histogram": Command(describe.histogram, 1, 0, ("explore",)),
    "pareto": Command(describe.pareto, 0, 1, ("explore", "quality")),
    "cross_table": Command(describe.cross_table, 0, 2, ("explore", "compare")),
    "individuals": Command(spc.individuals, 1, 0, ("stability", "quality")),
    "xbar_r": Command(spc.xbar_r, 1, 1, ("stability", "quality")),
    "attribute_chart": Command(spc.attribute_chart, 2, 0, ("stability", "quality")),
    "normal_capability": Command(capability.normal_capability, 1, 1, ("capability", "quality")),
    "nonparametric_capability": Command(capability.nonparametric, 1, 0, ("capability",)),
    "crossed_gage": Command(msa.crossed_gage, 1, 2, ("measurement",)),
    "type_1": Command(msa.type_1, 1, 0, ("measurement",)),
    "two_sample_t": Command(inference.two_sample_t, 1, 1, ("compare",)),
    "one_way_anova": Command(inference.one_way_anova, 1, 1, ("compare",)),
    "kruskal_wallis": Command(nonparametric.kruskal_wallis, 1, 1, ("compare",)),
    "correlations": Command(inference.correlations, 2, 0, ("relate",)),
    "linear_regression": Command(regression.linear_regression, 2, 0, ("relate", "predict")),
    "pca": Command(multivariate.pca, 3, 0, ("relate", "explore")),
    "acf": Command(timeseries.acf, 1, 0, ("forecast",)),
    "single_smoothing": Command(timeseries.single_smoothing, 1, 0, ("forecast",)),
    "kaplan_meier": Command(reliability.kaplan_meier, 1, 1, ("reliability",)),
    "weibull": Command(reliability.weibull, 1, 1, ("reliability",)),
}


def run(name: str, df: DataFrame, *args, **options) -> DataFrame:
    """Run an operator by name; an unknown name raises KeyError with the known ones."""
    if name not in COMMANDS:
        raise KeyError(f"{name} is none of {', '.join(sorted(COMMANDS))}")
    return COMMANDS[name].function(df, *args, **options)


def recommend(kinds: dict[str, str], intent: str | None = None, most: int = 8) -> list[tuple[str, int]]:
    """(command, score) for columns of these kinds: what fits, the intent's first, closer needs before looser ones."""
    numeric = sum(k == "numeric" for k in kinds.values())
    categorical = sum(k == "categorical" for k in kinds.values())
    fits = [(n, c) for n, c in COMMANDS.items() if c.numeric <= numeric and c.categorical <= categorical]
    scored = [(n, 10 * (intent in c.intents) + 2 * c.numeric + 2 * c.categorical) for n, c in fits]
    return sorted(scored, key=lambda s: (-s[1], s[0]))[:most]
