"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Every document falls in a cell (source, language, topic). The tokens of each cell are summed in one aggregation; a table
of up to CELLS cells is raked on the driver, a larger one the same way as a DataFrame, written after each margin. Raking scales the cells so that the token shares of sources, languages and topics
meet their targets, one margin after another until all three hold. A document is then kept with the probability of its
cell, the ratio of raked to present tokens times a scale, 1 at most; a hash of its id and text decides, so the choice is
the same in every run and on every executor. The scale is the largest at which the cells that have too few tokens for
it, which stay whole, lack SHORT of the wanted tokens in all; so how much stays does not hang on the rarest cell, and the
shares kept are off by about SHORT at most.

Every source, language and topic has its own margin, however many there are. Targets are the present shares to the power
of TEMPER, evened out but not flat, unless the caller names them.

Cases: null source or language is the value `none`; a document without tokens weighs nothing and is kept; a target of 0
drops its cells; repeated rows share one decision; an empty table gives no rows. Other columns are ignored unless
`carry` names them; they come back in one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import WS, text_of, written

TEMPER, SHORT = 0.9, 0.01
#: Cells that are raked on the driver.
CELLS = 4000
KEYS = ("source", "lang", "topic")
ROUNDS, EXACT = 200, 1e-9
#: Topics in order; the first whose sign a text contains is its topic. Plain searches: no regex runs over the text.
TOPICS = (
    ("contact", ("@",)),
    ("legal", ("icens", "icenc", "opyright", "ll rights reserved")),
    ("table", (" | ",)),
)


def token_count(text: Column) -> Column:
    """Words between white space."""
    body = F.trim(F.regexp_replace(text, WS, " "))
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, signs in reversed(TOPICS):
        found = F.lit(False)
        for sign in signs:
            found = found | F.contains(text, F.lit(sign))
        topic = F.when(found, F.lit(name)).otherwise(topic)
    return topic


def tempered(tokens: dict[str, float], power: float = TEMPER) -> dict[str, float]:
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]]) -> dict[tuple[str, ...], float]:
    """Cells scaled to total 1 whose margins meet the targets (as far as the cells that are not empty allow)."""
    total = sum(cells.values())
    now = {k: v / total for k, v in cells.items()} if total else dict(cells)
    for _ in range(ROUNDS):
        worst = 0.0
        for axis, target in enumerate(targets):
            have: dict[str, float] = {}
            for k, v in now.items():
                have[k[axis]] = have.get(k[axis], 0.0) + v
            full = sum(target.get(m, 0.0) for m, v in have.items() if v > 0)
            for m, v in have.items():
                want = target.get(m, 0.0) / full if full else 0.0
                worst = max(worst, abs(v - want))
                have[m] = want / v if v > 0 else 0.0
            now = {k: v * have[k[axis]] for k, v in now.items()}
        if worst < EXACT:
            break
    return now


def scale(raked: dict[tuple[str, ...], float], present: dict[tuple[str, ...], float]) -> float:
    """The largest factor of the raked shares at which cells lack SHORT of the tokens wanted; both total 1."""
    u = 0.0  # Newton's method on sum(max(0, raked - u * present)) = SHORT, which is convex in u = 1 / scale
    while True:
        over = [k for k, v in present.items() if raked[k] > u * v]
        after = (math.fsum(raked[k] for k in over) - SHORT) / total if (total := math.fsum(present[k] for k in over)) else u
        if after <= u * (1 + 1e-12):
            return 1 / u if u else 0.0
        u = after


def probabilities(cells: dict[tuple[str, ...], float], targets: list[dict[str, float]]) -> dict[tuple[str, ...], float]:
    total = sum(cells.values())
    raked = rake(cells, targets)
    present = {k: v / total for k, v in cells.items() if v > 0}
    factor = scale(raked, present)
    return {k: min(1.0, raked[k] * factor / present[k]) if v > 0 else 1.0 for k, v in cells.items()}


def rake_table(cells: DataFrame, targets: list[dict[str, float]] | None) -> DataFrame:
    """probabilities() of a cell table (source, lang, topic, n) that may be too large for the driver; the same steps."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    if not total:
        return cells.select(*KEYS, F.lit(1.0).alias("probability"))
    now = written(cells.filter("n > 0").select(*KEYS, (F.col("n") / total).alias("present"), (F.col("n") / total).alias("share")), "raked")
    wanted = []
    for axis, key in enumerate(KEYS):
        if targets is None:
            raised = now.groupBy(key).agg(F.pow(F.sum("present"), F.lit(TEMPER)).alias("target"))
            wanted.append(written(raised, "targets"))  # rake() divides by their sum
        else:
            wanted.append(spark.createDataFrame([(k, float(v)) for k, v in targets[axis].items()], f"{key} string, target double"))
    for _ in range(ROUNDS):
        worst = 0.0
        for key, target in zip(KEYS, wanted, strict=True):
            have = now.groupBy(key).agg(F.sum("share").alias("v")).join(target, key, "left")
            have = written(have.select(key, "v", F.coalesce("target", F.lit(0.0)).alias("target")), "margin")
            full = float(have.filter("v > 0").agg(F.sum("target")).first()[0] or 0)
            want = F.col("target") / full if full else F.lit(0.0)
            worst = max(worst, have.agg(F.max(F.abs(F.col("v") - want))).first()[0])
            factor = have.select(key, F.when(F.col("v") > 0, want / F.col("v")).otherwise(0.0).alias("factor"))
            now = written(now.join(factor, key).select(*KEYS, "present", (F.col("share") * F.col("factor")).alias("share")), "raked")
        if worst < EXACT:
            break
    u = 0.0  # as in scale()
    while True:
        raked, present = now.filter(F.col("share") > F.lit(u) * F.col("present")).agg(F.sum("share"), F.sum("present")).first()
        after = (raked - SHORT) / present if present else u
        if after <= u * (1 + 1e-12):
            break
        u = after
    chance = F.least(F.lit(1.0), F.col("share") / F.col("present") / u) if u else F.lit(0.0)
    return now.select(*KEYS, chance.alias("probability")).union(cells.filter("n = 0").select(*KEYS, F.lit(1.0)))


def draw(id_col: Column, text: Column) -> Column:
    """A number from 0 to 1 for each document."""
    return F.pmod(F.xxhash64(id_col, text, F.lit(23)), F.lit(1 << 52)) / float(1 << 52)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: list[dict[str, float]] | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept for every row. `targets`: shares of sources, languages and topics."""
    text = text_of(text_col)
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry is not None else []
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("none")).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("none")).alias("lang"), topic_of(text).alias("topic"), token_count(text).alias("tokens"), draw(F.col(id_col), text).alias("draw"), *extra)
    light = rows.select("source", "lang", "topic", "tokens")

    found = light.groupBy(*KEYS).agg(F.sum("tokens").alias("n"))
    few = found.limit(CELLS + 1).collect()
    if len(few) > CELLS:
        weights = written(rake_table(written(found, "cells"), targets), "weights")
    else:
        cells = {tuple(r[:3]): float(r[3]) for r in few}
        if targets is None:
            targets = []
            for axis in range(3):
                have: dict[str, float] = {}
                for k, v in cells.items():
                    have[k[axis]] = have.get(k[axis], 0.0) + v
                targets.append(tempered(have))
        chance = probabilities(cells, targets)
        weights = F.broadcast(df.sparkSession.createDataFrame([(*k, float(p)) for k, p in sorted(chance.items())], "source string, lang string, topic string, probability double"))
    out = rows.join(weights, list(KEYS))
    keep = (F.col("tokens") == 0) | (F.col("draw") < F.col("probability"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", "probability", keep.alias("kept"), *(["row"] if extra else []))
