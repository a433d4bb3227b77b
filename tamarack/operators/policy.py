"""Regex rules over texts with a fail-closed verdict."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    rule_id: str
    forbid: Sequence[str] = ()
    require: Sequence[str] = ()


def evaluate(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """texts: id, text. Adds violations (rule ids, in the rules' order) and passed; a null text fails every rule."""
    t = F.col("text")
    broken = []
    for r in rules:
        bad = F.lit(False)
        for p in r.forbid:
            bad = bad | t.rlike(p)
        for p in r.require:
            bad = bad | ~t.rlike(p)
        broken.append(F.when(F.coalesce(bad, F.lit(True)) | t.isNull(), F.lit(r.rule_id)))
    return texts.select("id", F.array_compact(F.array(*broken)).alias("violations")).withColumn("passed", F.size("violations") == 0)
