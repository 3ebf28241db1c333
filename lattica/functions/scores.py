"""Scores of documents and edges: products of dimensions, power amplification, grounding, decay, information."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 1.5

# Weights of context elements found in a text, and the signs they are found by.
CONTEXT_SIGNS = {
    "proofs": (0.2, ["theorem", "proof"]),
    "pseudocode": (0.3, ["algorithm", "procedure"]),
    "experiments": (0.3, ["experiment", "results"]),
    "examples": (0.25, ["example", "case study"]),
    "code": (0.25, ["code", "implementation"]),
}

# Weights of rated context elements, and the quality taken where none is given.
ELEMENT_WEIGHTS = {"mathematical_formulas": 0.15, "pseudocode": 0.25, "examples": 0.20, "code_snippets": 0.20, "diagrams": 0.10, "hyperparameters": 0.10}
DEFAULT_QUALITY = 0.8

# Shares of the grounding score; the signs are this engine's own choice.
GROUNDING = {"formulas": 40, "steps": 60, "hardware": 40, "outputs": 40, "criteria": 20}
GROUNDING_SIGNS = {"formulas": ["$", "equation", "formula"], "steps": ["step", "algorithm", "procedure"], "hardware": ["gpu", "cpu", "memory"], "outputs": ["result", "output", "figure"], "criteria": ["accuracy", "metric", "measure"]}

# Conveyance points of four kinds of evidence.
CONVEYANCE_BASE = {"formulas": 0.2, "pseudocode": 0.3, "examples": 0.2, "code": 0.3}


def information(*dims: Column) -> Column:
    """Product of the dimensions; a missing one counts as 0, so one zero makes all zero."""
    return reduce(lambda a, b: a * b, [F.coalesce(d.cast("double"), F.lit(0.0)) for d in dims])


def clamped_information(dims: Column) -> Column:
    """Product of an array of dimensions, none above 1."""
    return F.aggregate(dims, F.lit(1.0), lambda p, x: p * F.least(F.lit(1.0), x))


def log_information(*dims: Column) -> Column:
    """The product by way of logarithms; 0 if a dimension is 0, negative or missing."""
    some_zero = reduce(lambda a, b: a | b, [F.coalesce(d <= 0, F.lit(True)) for d in dims])
    return F.when(some_zero, 0.0).otherwise(F.exp(reduce(lambda a, b: a + b, [F.ln(d) for d in dims])))


def additive(*dims: Column) -> Column:
    """Mean of the dimensions; a missing one counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(d.cast("double"), F.lit(0.0)) for d in dims]) / len(dims)


def amplify(context: Column, alpha: float | Column = ALPHA) -> Column:
    """context ** alpha."""
    return F.pow(context, alpha if isinstance(alpha, Column) else F.lit(float(alpha)))


def change(context: Column, alpha: float = ALPHA) -> Column:
    """Relative change by amplification; null at 0."""
    return F.when(context != 0, amplify(context, alpha) / context - 1)


def transfer(ground_a: Column, ground_b: Column, context: Column, alpha: float = ALPHA) -> Column:
    """Mean grounding of both ends times amplified context."""
    return (ground_a + ground_b) / 2 * amplify(context, alpha)


def conveyance(base: Column, context: Column, grounding: Column, alpha: float | Column = ALPHA) -> Column:
    return base * amplify(context, alpha) * grounding


def actionable(conveyed: Column, grounding: Column) -> Column:
    """What is left after entropy, which is 1 - grounding."""
    return conveyed * (1 - (1 - grounding))


def capped_conveyance(base: Column, context: Column, alpha: float = ALPHA) -> Column:
    return F.least(F.lit(1.0), base * amplify(context, alpha))


def recursive_conveyance(base: Column, context: Column, depth: int = 10) -> Column:
    """f = base (1 + context f') / 2, ``depth`` times, from base."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), base, lambda f, _: base * (1 + context * f) / 2)


def context_from_text(text: Column) -> Column:
    """Sum of the weights of the elements whose signs occur, at most 1."""
    low = F.lower(text)
    parts = [F.when(reduce(lambda a, b: a | b, [low.contains(s) for s in signs]), w).otherwise(0.0) for w, signs in CONTEXT_SIGNS.values()]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def context_from_elements(present: dict[str, Column], quality: dict[str, Column] | None = None) -> Column:
    """Sum of weight times quality over the elements that are present."""
    quality = quality or {}
    return reduce(lambda a, b: a + b, [F.when(c, ELEMENT_WEIGHTS[n] * F.coalesce(quality.get(n, F.lit(None).cast("double")), F.lit(DEFAULT_QUALITY))).otherwise(0.0) for n, c in present.items()])


def grounding(text: Column) -> Column:
    """Share of the grounding points whose signs occur in a text."""
    low = F.lower(text)
    parts = [F.when(reduce(lambda a, b: a | b, [low.contains(s) for s in GROUNDING_SIGNS[n]]), float(p)).otherwise(0.0) for n, p in GROUNDING.items()]
    return reduce(lambda a, b: a + b, parts) / float(sum(GROUNDING.values()))


def decayed(start: Column, rate: Column, t: Column) -> Column:
    return start * F.exp(-rate * t)


def half_life(rate: Column) -> Column:
    return F.when(rate > 0, F.ln(F.lit(2.0)) / rate)


def survival(risks: Column) -> Column:
    """Product of 1 - risk."""
    return F.aggregate(risks, F.lit(1.0), lambda p, r: p * (1 - r))


def where_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def when_score(gap: Column, span: Column) -> Column:
    """1 - |gap| / span, 0 where the span is 0."""
    return F.when(span > 0, 1 - F.abs(gap) / span).otherwise(0.0)


def frame(source_time: Column, target_time: Column, parts: dict[str, tuple[float, Column]]) -> Column:
    """0 if the source is later than the target, else the weighted sum of the parts."""
    total = reduce(lambda a, b: a + b, [w * F.coalesce(c, F.lit(0.0)) for w, c in parts.values()])
    return F.when(source_time > target_time, 0.0).otherwise(total)


def observed(gate: Column, *dims: Column) -> Column:
    """The product if the gate is 1, else 0."""
    return F.when(gate == 1, information(*dims)).otherwise(0.0)


def anti_context(richness: Column, grounded: Column) -> Column:
    return richness * (1 - grounded)


def persistence(amplification: Column, use: Column, costs: Column) -> Column:
    return amplification * use - F.aggregate(costs, F.lit(0.0), lambda s, x: s + x)


def bridge_score(size: Column, abstract_length: Column, categories: Column) -> Column:
    """How many of three marks of a bridge hold."""
    return (size > 5).cast("int") + (abstract_length > 1000).cast("int") + (categories > 2).cast("int")


def least_dimensions(n: Column, epsilon: Column) -> Column:
    """Dimensions that keep the distances of n points within epsilon."""
    return 4 * F.ln(n) / (epsilon * epsilon / 2 - epsilon * epsilon * epsilon / 3)
