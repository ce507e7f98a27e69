"""Checks of evaluation runs: which expected properties an investigation has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidences from weak to strong.
LEVELS = ("low", "medium", "high")


def expected_verdicts(allowed: Column, one: Column) -> Column:
    """The verdicts that a fixture permits: its list, else its single one, else none."""
    none = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(allowed, none)) > 0, allowed).when(one.isNotNull(), F.array(one)).otherwise(none)


def is_attack(verdicts: Column) -> Column:
    """A fixture whose expectation names verdicts and doesn't permit a false positive; one without any isn't assumed hostile."""
    return (F.size(verdicts) > 0) & ~F.array_contains(verdicts, "false_positive")


def _level(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), c)


def property_checks(runs: DataFrame, autoclose: Column) -> DataFrame:
    """(fixture, mode, run, property, ok): a row for each property that a fixture pins and each of its runs.

    runs: fixture, mode, run; the investigation's verdict, confidence, attack_techniques, escalation_recommended, pivots (array
    of texts), n_evidence, n_groups, n_sigma, n_injection; and expected, a struct of allowed_verdicts, expected_verdict,
    min_confidence, required_techniques, any_of_techniques (array of arrays), forbidden_techniques, must_escalate,
    pivots_must_include (array of arrays of words), min_evidence_count, min_associated_groups, min_sigma_matches,
    min_injection_flags; what is null isn't checked. ``autoclose``: whether the production gate would close the run's alert.
    """
    e, techniques = F.col("expected"), F.array_join("attack_techniques", " ")
    pivots = F.lower(F.array_join("pivots", " "))
    verdicts = expected_verdicts(e["allowed_verdicts"], e["expected_verdict"])
    has = lambda t: F.contains(techniques, t)
    at_least = lambda have, key: F.when(e[key].isNotNull(), F.col(have) >= e[key])
    checks = {
        "verdict": F.when((F.size(verdicts) > 0) | e["allowed_verdicts"].isNotNull(), F.array_contains(verdicts, F.col("verdict"))),
        "confidence": F.when(e["min_confidence"].isNotNull(), _level(F.col("confidence")) >= _level(e["min_confidence"])),
        "required_techniques": F.forall(e["required_techniques"], has),
        "any_of_techniques": F.forall(e["any_of_techniques"], lambda g: F.exists(g, has)),
        "forbidden_techniques": ~F.exists(e["forbidden_techniques"], has),
        "escalation": F.col("escalation_recommended") == e["must_escalate"],
        "pivots": F.forall(e["pivots_must_include"], lambda words: F.exists(words, lambda w: F.contains(pivots, F.lower(w)))),
        "evidence_count": at_least("n_evidence", "min_evidence_count"), "associated_groups": at_least("n_groups", "min_associated_groups"),
        "sigma_matches": at_least("n_sigma", "min_sigma_matches"), "injection_flags": at_least("n_injection", "min_injection_flags"),
        "autoclose_safe": F.when(is_attack(verdicts), ~F.coalesce(autoclose, F.lit(False))),
    }
    found = F.array(*(F.struct(F.lit(name).alias("property"), ok.alias("ok")) for name, ok in checks.items()))
    return runs.select("fixture", "mode", "run", F.explode(found).alias("c")).where("c.ok is not null").select("fixture", "mode", "run", "c.property", "c.ok")
