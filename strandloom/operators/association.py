"""Association of clusters with traits given the structure of the population.

Clusters with the same genomes share a pattern, and each pattern is fitted once: the trait on a
constant, the genomes' axes and the pattern, against the fit without the pattern. Patterns are
spread over the tasks; a task fits blocks of them together, all Newton steps of a block in one
array. Axes and traits are held by every task: a few numbers for each genome.

Defined results. Only genomes with a value and axes count for a trait. A pattern that all or none
of them have has lrt 0, p-value 1 and effect 0. A pattern that separates the trait has no finite
effect: it is null, lrt and p-value are those of the limit. A trait without genomes, or a 0/1
trait of which all genomes have the same value, has lrt 0 and p-value 1 everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.shared import folded
from strandloom.session import ship

#: Numbers of a block of design matrices, Newton steps, halvings of a step, and the gain in log-likelihood below which a fit is settled.
BLOCK_NUMBERS, STEPS, HALVINGS, SETTLED = 1 << 21, 80, 20, 1e-10
#: A linear predictor beyond this is a fitted probability of 0 or 1: the pattern separates the trait.
SEPARATED = 15.0


def logistic_fits(y: np.ndarray, designs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihoods, coefficients, largest linear predictors) of the 0/1 values y on each of the designs (fits, genomes, columns)."""
    n, _, p = designs.shape

    def likelihood(d: np.ndarray, b: np.ndarray) -> np.ndarray:
        eta = (d @ b[:, :, None])[:, :, 0]
        return (y * eta - np.logaddexp(0, eta)).sum(axis=1)

    beta = np.zeros((n, p))
    fit = likelihood(designs, beta)
    live = np.arange(n)
    for _ in range(STEPS):
        if not len(live):
            break
        d, b, now = designs[live], beta[live], fit[live]
        expected = 0.5 * (1 + np.tanh((d @ b[:, :, None])[:, :, 0] / 2))
        slope = ((y - expected)[:, None, :] @ d)[:, 0, :]
        bend = (d * (expected * (1 - expected))[:, :, None]).transpose(0, 2, 1) @ d
        ridge = 1e-9 * np.trace(bend, axis1=1, axis2=2) / p + 1e-14
        step = np.linalg.solve(bend + ridge[:, None, None] * np.eye(p), slope[:, :, None])[:, :, 0]
        size = np.ones(len(live))
        for _ in range(HALVINGS):
            tried = likelihood(d, b + size[:, None] * step)
            worse = ~(tried >= now)
            if not worse.any():
                break
            size[worse] /= 2
        better = tried > now
        beta[live[better]], fit[live[better]] = (b + size[:, None] * step)[better], tried[better]
        live = live[better & (tried - now > SETTLED)]
    return fit, beta, np.abs((designs @ beta[:, :, None])[:, :, 0]).max(axis=1, initial=0)


def tested_patterns(y: np.ndarray, base: np.ndarray, patterns: np.ndarray, continuous: bool) -> tuple[np.ndarray, np.ndarray]:
    """(effects, likelihood ratios) of the rows of patterns (fits, genomes) beside the columns of base; an effect without bound is nan."""
    n, size = patterns.shape
    effect, ratio = np.zeros(n), np.zeros(n)
    varies = np.flatnonzero((patterns.any(axis=1) & ~patterns.all(axis=1)) if size else np.zeros(n, dtype=bool))
    if not len(varies) or np.all(y == y[0]):
        return effect, ratio
    x = patterns[varies].astype(float)
    if continuous:
        q, _ = np.linalg.qr(base)
        own, rest = y - q @ (q.T @ y), x - (x @ q) @ q.T
        weight, left = (rest * rest).sum(axis=1), float(own @ own)
        free = weight > 1e-9 * x.sum(axis=1)
        if left <= 1e-12 * float(y @ y):
            return effect, ratio
        slope = np.divide(rest @ own, weight, out=np.zeros(len(x)), where=free)
        effect[varies] = slope
        ratio[varies] = -size * np.log(np.maximum(1 - slope * slope * weight / left, 1e-300))
        return effect, ratio
    none = logistic_fits(y, base[None])[0][0]
    block = max(1, BLOCK_NUMBERS // (size * (base.shape[1] + 1)))
    for at in range(0, len(x), block):
        part = x[at : at + block]
        designs = np.concatenate((np.broadcast_to(base, (len(part), *base.shape)), part[:, :, None]), axis=2)
        fit, beta, largest = logistic_fits(y, designs)
        own = varies[at : at + block]
        effect[own] = np.where(largest > SEPARATED, np.nan, beta[:, -1])
        ratio[own] = np.maximum(0.0, 2 * (fit - none))
    return effect, ratio


def structured_association(presence: DataFrame, traits: DataFrame, axes: Mapping[str, Sequence[float]] | None = None, continuous: bool = False) -> DataFrame:
    """(cluster_id, trait, n, present, effect, lrt, p_value) of presence and (genome_id, trait, value).

    axes: numbers of each genome that describe the structure, such as its place in the plane;
    without them only the pattern is fitted. p_value: chi-square of one degree of freedom.
    """
    values: dict[str, dict[str, float]] = {}
    for r in traits.where("genome_id is not null and trait is not null and value is not null").collect():
        if axes is None or r["genome_id"] in axes:
            values.setdefault(r["trait"], {})[r["genome_id"]] = float(r["value"])
    models = []
    for trait, own in sorted(values.items()):
        genomes = sorted(own)
        base = np.array([(1.0, *(axes[g] if axes else ())) for g in genomes])
        models.append((trait, genomes, np.array([own[g] for g in genomes]), base))
    ship(presence.sparkSession)
    named = folded(presence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("genomes")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for trait, genomes, y, base in models:
                place = pc.index_in(lists.flatten(), value_set=pa.array(genomes, pa.string()))
                known = place.is_valid().to_numpy(zero_copy_only=False)
                has = np.zeros((batch.num_rows, len(genomes)), dtype=bool)
                has[row[known], place.drop_null().to_numpy()] = True
                effect, ratio = tested_patterns(y, base, has, continuous)
                p = [math.erfc(math.sqrt(v / 2)) for v in ratio.tolist()]
                n = np.full(batch.num_rows, len(genomes))
                yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array([trait] * batch.num_rows), pa.array(n), pa.array(has.sum(axis=1)), pa.array(effect, from_pandas=True), pa.array(ratio), pa.array(p, pa.float64())], names=["pattern", "trait", "n", "present", "effect", "lrt", "p_value"])

    fitted = named.groupBy("pattern").agg(F.first("genomes").alias("genomes")).mapInArrow(run, "pattern string, trait string, n long, present long, effect double, lrt double, p_value double")
    return named.select("cluster_id", "pattern").join(fitted, "pattern").drop("pattern")
