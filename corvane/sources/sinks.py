"""Files for people and other programs: the dictionary, evaluation reports, what an evaluation must reach."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dictionary(words: DataFrame, path: str) -> None:
    """(folded, form, share) as CSV with a header, in the order of the folded words. A corpus's dictionary is one file of some megabytes."""
    words.select("folded", "form", F.round("share", 4).alias("share")).repartition(1).sortWithinPartitions("folded", "form").write.mode("overwrite").csv(path, header=True)


def write_report(cases: DataFrame, path: str) -> None:
    """Scored cases as JSON lines, in the order of their ids."""
    cases.repartition(1).sortWithinPartitions("case_id").write.mode("overwrite").json(path)


def report(metrics: dict[str, float], missed: list[tuple[str, float, float]]) -> str:
    """Metrics and missed thresholds as text."""
    lines = [f"{name:<24}{value:8.3f}" for name, value in metrics.items()]
    return "\n".join([*lines, *(f"below threshold: {name} {got:.3f} < {want:.3f}" for name, got, want in missed)])


def missed(metrics: dict[str, float], least: dict[str, float], cases: dict[str, int]) -> list[tuple[str, float, float]]:
    """(metric, value, threshold) of what is below its threshold; a threshold of 0 and a metric without cases don't count."""
    return [(name, metrics[name], want) for name, want in least.items() if want > 0 and cases.get(name, 0) > 0 and metrics[name] < want]


def rounds(step: Callable[[], int], most: int) -> int:
    """Repeats a step that tells how many rows it changed, until it changes none, `most` times at the most; how often it ran."""
    for k in range(1, most + 1):
        if not step():
            return k
    return most


def as_json(metrics: dict[str, float]) -> str:
    return json.dumps(metrics, sort_keys=True)
