"""Scores of models: speed, reliability, intelligence, headroom and their mix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scales, priors and weights of the axes, and the presets (reliability, speed, intelligence).
SPEED_SCALE, TTFB_BEST, TTFB_WORST, THROUGHPUT_WEIGHT, TTFB_WEIGHT, SPEED_PRIOR = 60.0, 300.0, 5000.0, 0.6, 0.4, 0.6
PRIOR_SUCCESS, PRIOR_FAILURE, RANK_SCALE, HEADROOM_FLOOR, HEADROOM_START = 1.0, 1.0, 31.0, 0.1, 0.2
PRESETS = {"balanced": (0.5, 0.25, 0.25), "smartest": (0.35, 0.1, 0.55), "fastest": (0.35, 0.55, 0.1), "reliable": (0.7, 0.15, 0.15)}
MOST_PENALTY, MOST_DAMP = 10, 0.95
TIERS = {"frontier": 4, "large": 3, "medium": 2, "small": 1}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def reliability(good: Column, bad: Column, prior_good: Column | None = None, prior_bad: Column | None = None) -> Column:
    """The expected share of successes, from own counts and, if there are any, those that others report."""
    more = lambda c: F.lit(0.0) if c is None else F.coalesce(c, F.lit(0.0))
    own = F.greatest(good, F.lit(0.0)) + more(prior_good) + PRIOR_SUCCESS
    return own / (own + F.greatest(bad, F.lit(0.0)) + more(prior_bad) + PRIOR_FAILURE)


def speed(tokens_per_s: Column, ttfb_ms: Column) -> Column:
    ramp = clamp((F.lit(TTFB_WORST) - ttfb_ms) / (TTFB_WORST - TTFB_BEST))
    fast = F.lit(1.0) - F.exp(-tokens_per_s / SPEED_SCALE)
    return F.when((tokens_per_s <= 0) & ttfb_ms.isNull(), F.lit(SPEED_PRIOR)).otherwise(THROUGHPUT_WEIGHT * fast + TTFB_WEIGHT * F.coalesce(ramp, F.lit(SPEED_PRIOR)))


def speed_rank(score: Column) -> Column:
    return F.least(F.greatest(F.lit(1) + F.round((F.lit(1.0) - score) * 9), F.lit(1)), F.lit(10)).cast("int")


def intelligence(size_label: Column, rank: Column) -> Column:
    tier = F.lit(0)
    for label, t in TIERS.items():
        tier = F.when(size_label == label, t).otherwise(tier)
    return tier * 1000 - F.sqrt(rank) * RANK_SCALE


def headroom(used: Column, budget: Column) -> Column:
    """1 while HEADROOM_START of a budget is left, then down to HEADROOM_FLOOR; 1 without a known budget."""
    left = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(used, F.lit(0)) / F.nullif(budget, F.lit(0)))
    return F.when(F.coalesce(budget, F.lit(0)) <= 0, 1.0).when(left >= HEADROOM_START, 1.0).otherwise(HEADROOM_FLOOR + (1 - HEADROOM_FLOOR) * left / HEADROOM_START)


def rate_limit_factor(penalty: Column) -> Column:
    """1 without a penalty, down to 1 - MOST_DAMP at MOST_PENALTY."""
    return F.lit(1) - clamp(penalty, 0, MOST_PENALTY) / MOST_PENALTY * MOST_DAMP


def mixed(preset: str, reliability_: Column, speed_: Column, intelligence_: Column, head: Column, limited: Column) -> Column:
    """The axes by the weights of a preset, which count as shares of their sum, times both factors."""
    r, s, i = PRESETS[preset]
    return (r * reliability_ + s * speed_ + i * intelligence_) / (r + s + i) * head * limited


# Fixed value: the form of a budget label: a number or a range, and M or K, wherever it stands in the label.
BUDGET_LABEL = r"~?([0-9.]+)(?:-([0-9.]+))?([MK])"


def budget_tokens(label: Column) -> Column:
    """Tokens of a budget label such as ``~5-10M``, ``~1.5M (trial)`` or ``20K``: the upper end; 0 for labels without a unit."""
    part = lambda i: F.regexp_extract(label, BUDGET_LABEL, i)
    number = F.regexp_extract(F.coalesce(F.nullif(part(2), F.lit("")), part(1)), r"^[0-9]*\.?[0-9]*", 0).try_cast("double")
    unit = F.when(part(3) == "M", 1_000_000).when(part(3) == "K", 1000)
    return F.coalesce(F.round(number * unit).cast("long"), F.lit(0).cast("long"))


# Fixed value: tokens that are allowed at most where a request asks for no number.
MOST_OUTPUT = 4096


def token_budget(estimated: Column, asked: Column, budget: int) -> Column:
    """(verdict, max_tokens) of a request within ``budget`` tokens, 0 for none: reject if the estimate and what it asks for are more, or nothing would be left; if it asks for no
    number, cap at what is left and MOST_OUTPUT; else ok as it is."""
    if budget <= 0:
        return F.struct(F.lit("ok").alias("verdict"), asked.cast("long").alias("max_tokens"))
    left = F.lit(budget) - estimated
    reject = (estimated + F.coalesce(asked, F.lit(0)) > budget) | (asked.isNull() & (left < 1))
    verdict = F.when(reject, "reject").when(asked.isNull(), "cap").otherwise("ok")
    return F.struct(verdict.alias("verdict"), F.when(~reject, F.coalesce(asked, F.least(left, F.lit(MOST_OUTPUT)))).cast("long").alias("max_tokens"))
