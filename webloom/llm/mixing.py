"""Mixing sources to target weights: balanced sampling by the cube method."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, bound_batches, id_column, small_side, wide_key
from .language_id import TOKENIZERS
from .tokens import count_udf

EPS = 1e-9
UNITS = "k1 bigint, k2 bigint, source string, m bigint, t bigint, p double"


def flight(m: list[float], t: list[float], p: list[float], draw: random.Random) -> list[float]:
    """Flight phase: move p through the null space of the two constraints sum(m * p) and sum(t * p) until at most two entries are
    fractional. Each step takes three fractional units, whose null vector is the cross product of their m and t, and moves as far
    as the unit cube allows, forwards or backwards with the probabilities that keep every expectation; so one entry at least
    becomes 0 or 1."""
    p, active = list(p), []
    for i, x in enumerate(p):
        if x <= EPS or x >= 1 - EPS:
            p[i] = float(x >= 0.5)
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (m[b] * t[c] - m[c] * t[b], m[c] * t[a] - m[a] * t[c], m[a] * t[b] - m[b] * t[a])
            size = max(map(abs, u))
            scale = max(m[a], m[b], m[c]) * max(t[a], t[b], t[c])
            if size <= 1e-12 * max(scale, 1e-300):  # like units: trade the first two
                u = (m[b], -m[a], 0.0)
            active = step(p, active, u, draw)
    return p


def step(p: list[float], at: list[int], u: tuple[float, ...], draw: random.Random) -> list[int]:
    """Move p[at] along u or against it to the wall of the cube; the entries still fractional."""
    ahead = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(at, u) if x)
    back = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(at, u) if x)
    move = ahead if draw.random() * (ahead + back) < back else -back
    left = []
    for i, x in zip(at, u):
        p[i] += move * x
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = float(p[i] >= 0.5)
        else:
            left.append(i)
    return left


def land(m: list[float], p: list[float], draw: random.Random) -> list[float]:
    """Landing phase for what the last flight left: give up the balance of tokens, then that of documents, never an expectation."""
    p, active = list(p), []
    for i, x in enumerate(p):
        if not EPS < x < 1 - EPS:
            continue
        active.append(i)
        if len(active) == 2:
            a, b = active
            active = step(p, active, (m[b], -m[a]), draw)
    for i in active:
        p[i] = float(draw.random() < p[i])
    return p


def rates(totals: dict[str | None, int], weights: dict[str | None, float] | None, budget: float | None, temperature: float) -> dict[str | None, float]:
    """Expected copies of a text of each source: weight * budget / tokens of the source. Without weights they are tokens ** temperature;
    without a budget it is the largest under which no text is repeated. Sources without tokens, having no share, stay as they are."""
    live = {s: n for s, n in totals.items() if n > 0}
    if weights is None:
        weights = {s: n**temperature for s, n in live.items()}
    weights = {s: weights.get(s, 0.0) for s in live}
    total = sum(weights.values())
    if total <= 0:
        return {s: 1.0 if s not in live else 0.0 for s in totals}
    share = {s: w / total for s, w in weights.items()}
    if budget is None:
        budget = min(live[s] / share[s] for s in live if share[s] > 0)
    return {s: share[s] * budget / live[s] if s in live else 1.0 for s in totals}


def source_rates(sources: DataFrame, weights: dict[str | None, float] | None, budget: float | None, temperature: float) -> DataFrame:
    """sources (source, t tokens, n) with rate, as rates() gives it, by column arithmetic: the driver sees sums alone."""
    spark = sources.sparkSession
    if weights is None:
        weighed = sources.withColumn("w", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(float(temperature)))))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        weighed = sources.join(given, F.expr("source <=> name"), "left").select("source", "t", "n", F.when(F.col("t") > 0, F.coalesce("w", F.lit(0.0))).alias("w"))
    sums = weighed.agg(F.sum("w").alias("w"), F.min(F.when(F.col("w") > 0, F.col("t") / F.col("w"))).alias("least")).first()
    total = sums["w"] or 0.0
    if total <= 0:
        return weighed.select("source", "t", "n", F.when(F.col("w").isNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("rate"))
    size = float(budget) if budget is not None else sums["least"] * total
    return weighed.select("source", "t", "n", F.when(F.col("w").isNull(), F.lit(1.0)).otherwise(F.col("w") / F.lit(total) * F.lit(size) / F.col("t")).alias("rate"))


def fly(seed: int, landing: bool = False):
    """A group's flight; with landing, what is then fractional lands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2"]).reset_index(drop=True)
        draw = random.Random(f"{seed}:{pdf['k1'].iloc[0]}:{len(pdf)}")
        order = list(range(len(pdf)))
        draw.shuffle(order)
        pdf = pdf.iloc[order].reset_index(drop=True)
        m = pdf["m"].astype(float).tolist()
        p = flight(m, pdf["t"].astype(float).tolist(), pdf["p"].tolist(), draw)
        pdf["p"] = land(m, p, draw) if landing else p
        return pdf[["k1", "k2", "source", "m", "t", "p"]]

    return run


def keys_of(id_col: str, text_col: str, source_col: str, k1: str, k2: str) -> list[Column]:
    """128 bits by which rows that are equal in all three columns are known."""
    return [wide_key(id_col, text_col, source_col, seed=1).alias(k1), wide_key(id_col, text_col, source_col, seed=2).alias(k2)]


def decide(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str | None, float] | None = None, budget: float | None = None, temperature: float = 0.7, seed: int = 11, bucket: int = 4096, tokenizers: str = TOKENIZERS, budget_share: float = 1.0, broadcast_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(rows, picks): rows (k1, k2, doc_id, source, n_tokens) of all docs; picks (k1, k2, rate, copies) of their distinct keys."""
    bound_batches(docs.sparkSession)
    rows = scratch.keep(docs.select(*keys_of(id_col, text_col, source_col, "k1", "k2"), id_column(docs, id_col).alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), count_udf(tokenizers)(F.col(f"`{text_col}`")).alias("n_tokens")), "rows")
    sources = scratch.keep(rows.groupBy("source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")), "sources")
    seen = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    if budget is None:  # a share of all tokens, so that no single source sets the size of the mixture
        budget = budget_share * seen["t"]
    per = scratch.keep(source_rates(sources, weights, budget, temperature), "rates")
    by_source = lambda df: small_side(df, seen["n"], 64, broadcast_bytes)
    same = F.expr("u.source <=> r.source")
    # rows that are equal in all three columns are one unit and share a fate
    units = rows.groupBy("k1", "k2", "source").agg(F.count(F.lit(1)).alias("m"), F.sum("n_tokens").alias("t"))
    state = units.alias("u").join(by_source(per).alias("r"), same).select("k1", "k2", "u.source", "m", "u.t", (F.col("rate") - F.floor("rate")).alias("p"), F.ceil(F.col("n") / bucket).alias("buckets"))
    fractional, done, level = (F.col("p") > 0) & (F.col("p") < 1), [], 0
    while True:  # within each source
        spread = state.withColumn("bucket", F.pmod(F.xxhash64("k1", F.lit(seed + level)), F.col("buckets")))
        flown = scratch.keep(spread.groupBy("source", "bucket").applyInPandas(fly(seed + level), UNITS), "flown")
        done.append(flown.where(~fractional))
        left = flown.where(fractional)
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n").alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        level += 1
        if (most["most"] or 0) <= 2:
            break
        state = left.alias("u").join(by_source(counts).alias("r"), same).select("k1", "k2", "u.source", "m", "t", "p", F.ceil(F.col("n") / bucket).alias("buckets"))
    many = most["n"]
    while many:  # at most two units a source are fractional: balance the whole, then land
        parts = -(-many // bucket)
        spread = left.withColumn("bucket", F.pmod(F.xxhash64("k1", F.lit(seed + level)), F.lit(parts)))
        flown = scratch.keep(spread.groupBy("bucket").applyInPandas(fly(seed + level, landing=parts == 1), UNITS), "landed")
        done.append(flown.where(~fractional))
        if parts == 1:
            break
        left = flown.where(fractional)
        many, level = left.count(), level + 1
    picks = done[0]
    for d in done[1:]:
        picks = picks.unionByName(d)
    picks = picks.alias("u").join(by_source(per).alias("r"), same).select("k1", "k2", "rate", (F.floor("rate") + F.col("p").cast("bigint")).alias("copies"))
    return rows, picks


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: (doc_id, source, n_tokens, rate, copies).

    copies is how often the row enters the mixture (0: left out); its expectation is rate, weight * budget / tokens of the
    source. Without a budget the mixture has budget_share of all tokens, whatever the sources' sizes: rows of sources whose
    share of the weights is over their share of the tokens are repeated (rate over 1), those of others thinned out. Within each source the cube method keeps the totals of documents and of tokens at their targets: inclusion
    probabilities move through the null space of both constraints in buckets of equal size, at most two units a bucket stay
    fractional and go into buckets of the next level; the last two of each source are balanced over all, in buckets again, and
    then landed. Text is read once for token counts; what is shuffled is 40 bytes a row. The driver sees counts and sums alone,
    and the table of sources is broadcast only when it is within broadcast_bytes.

    Null and empty texts have 0 tokens and take part in the document total alone; very long ones count like others. A null source
    is a source of its own. Rows equal in doc_id, text and source are one unit (by a hash of 128 bits): all enter or none. A
    source without weight is left out; one without tokens stays whole. An empty table gives no rows; ids may have any type;
    columns that are not named are not read.
    """
    scratch, out = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows, picks = decide(docs, scratch, **options)
    result = out.keep(rows.join(picks, ["k1", "k2"]).select("doc_id", "source", "n_tokens", "rate", "copies"), "mixed")
    scratch.drop()
    return result


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """The rows of docs that mix() picks, each as often as it is picked; columns stay as they are. Nulls, empty texts, repeated rows and an
    empty table fare as in mix(); other columns may have any name."""
    scratch, out = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    _, picks = decide(docs, scratch, id_col, text_col, source_col, broadcast_bytes=broadcast_bytes, **options)
    picks = out.keep(picks.where("copies > 0").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("copies").alias("__copies")), "picks")
    scratch.drop()
    names = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *keys_of(id_col, text_col, source_col, "__k1", "__k2"))
    picked = marked.join(small_side(picks, picks.count(), 64, broadcast_bytes), ["__k1", "__k2"])
    return picked.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
