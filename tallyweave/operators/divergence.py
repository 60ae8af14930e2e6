"""Distance of a group's token distribution, or of its vectors, from an anchor."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.vectors import l2_distance, log_softmax, masked_sequence_mean
from tallyweave.operators.lookup import lookup

# Bytes of centre vectors that are broadcast at most.
CENTER_BYTES = 64 << 20


def align_distributions(left: DataFrame, right: DataFrame, token: str = "token", count: str = "cnt") -> DataFrame:
    """Both counts over the joint support; a token missing on one side counts 0.

    Both inputs are already one row per token, so the join has no hot key.
    """
    a = left.select(token, F.col(count).alias("p_cnt"))
    b = right.select(token, F.col(count).alias("q_cnt"))
    return a.join(b, token, "full_outer").select(
        token, F.coalesce("p_cnt", F.lit(0)).alias("p_cnt"), F.coalesce("q_cnt", F.lit(0)).alias("q_cnt")
    )


def kl_divergence(counts: DataFrame, group: str, alpha: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """KL(anchor || group) per group, anchor = all groups together.

    ``counts`` has one row per (group, token): ``group, token, cnt``; materialise
    it, it is read several times. Both sides get additive smoothing ``alpha`` over
    the joint vocabulary. With a temperature both are softened to
    ``p^(1/T) / sum p^(1/T)`` and the result is scaled by ``T^2``.

    A token that a group lacks has one constant probability there, so its share
    of the sum has a closed form: nothing of size groups x vocabulary is built.
    """
    if not (alpha > 0 and temperature > 0):
        raise ValueError("alpha and temperature must be positive")
    inv_t = 1.0 / temperature
    anchor_counts = counts.groupBy("token").agg(F.sum("cnt").alias("a_cnt"))
    size = anchor_counts.agg(F.count(F.lit(1)).alias("v"), F.sum("a_cnt").alias("n"))
    vocab, total = size.select("v").scalar(), size.select("n").scalar()

    anchor = anchor_counts.select(
        "token", F.pow((F.col("a_cnt") + alpha) / (total + F.lit(alpha) * vocab), F.lit(inv_t)).alias("pt")
    )
    z_p = anchor.agg(F.sum("pt")).scalar()
    anchor = anchor.select("token", (F.col("pt") / z_p).alias("p"))
    self_term = anchor.agg(F.sum(F.col("p") * F.ln("p"))).scalar()

    # ln q = ln(cnt + alpha) - ln(n_g + alpha * V): the group's total stays out of the
    # rows, so one aggregation per group is enough and no group-sized join is needed.
    ln_cnt = F.ln(F.col("cnt") + alpha)
    per_group = (
        counts.join(anchor, "token")
        .groupBy(group)
        .agg(
            F.sum("cnt").alias("n_g"),
            F.count(F.lit(1)).alias("v_g"),
            F.sum("p").alias("p_seen"),
            F.sum(F.col("p") * ln_cnt).alias("p_ln"),
            F.sum(F.exp(ln_cnt * inv_t)).alias("z_seen"),
        )
    )
    ln_alpha = F.lit(math.log(alpha))
    ln_norm = F.ln(F.col("n_g") + F.lit(alpha) * vocab)
    p_ln_q = F.col("p_ln") + (F.lit(1.0) - F.col("p_seen")) * ln_alpha - ln_norm
    ln_z = F.ln(F.col("z_seen") + (vocab - F.col("v_g")) * F.exp(ln_alpha * inv_t)) - ln_norm * inv_t
    cross = F.lit(inv_t) * p_ln_q - ln_z
    return per_group.select(group, ((self_term - cross) * F.lit(temperature**2)).alias("kl"))


def vector_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, center, cnt)``: mean vector and size per group.

    Whole vectors are added up in the JVM, first in each task: a row per group, not one per
    dimension, is shuffled. Null vectors are left out; the vectors of a group have one length.
    """
    rows = df.where(F.col(vector).isNotNull())
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.groupBy(group).agg(vector_to_array(mean).alias("center"), F.count(F.lit(1)).alias("cnt"))


def vector_l2_drift(
    df: DataFrame, group: str, vector: str, centers: DataFrame, center_bytes: int = CENTER_BYTES
) -> DataFrame:
    """Mean L2 distance of each vector to its group's centre vector.

    ``centers`` is the materialised result of ``vector_means``. The centres of the largest
    groups, as many as ``center_bytes`` hold, are broadcast, so a group with a third of all
    rows is not shuffled. Null vectors are left out.
    """
    dims = centers.agg(F.max(F.size("center"))).first()[0] or 1
    distance = l2_distance(F.col(vector), F.col("center"))
    parts = lookup(
        df.where(F.col(vector).isNotNull()).select(group, vector),
        centers,
        group,
        reduce=lambda found: found.groupBy(group).agg(
            F.sum(distance).alias("__sum"), F.count(F.lit(1)).alias("n")
        ),
        head_rows=center_bytes // (8 * dims),
    )
    return parts.groupBy(group).agg((F.sum("__sum") / F.sum("n")).alias("drift"), F.sum("n").alias("n"))


def masked_divergence(df: DataFrame, anchor: str, own: str, mask: str, *keys: str, temperature: float = 1.0) -> DataFrame:
    """``(*keys, kl)``: a row's divergence from its anchor, position by position.

    ``anchor`` and ``own`` are arrays of logit vectors, one for each position, and ``mask``
    holds a number for each. Every position's KL(anchor || own) counts with the mask of the
    next position; the sum is divided by the row's number of positions and scaled by the
    square of the temperature. All of it is column arithmetic inside the row.
    """

    def at(p: Column, q: Column) -> Column:
        parts = F.zip_with(log_softmax(p, temperature), log_softmax(q, temperature), lambda a, b: F.exp(a) * (a - b))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    values = F.zip_with(anchor, own, at)
    return df.select(*keys, (masked_sequence_mean(values, F.col(mask)) * F.lit(float(temperature) ** 2)).alias("kl"))
