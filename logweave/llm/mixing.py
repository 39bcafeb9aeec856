"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). A cell's inclusion
probability is min(1, a * b * c), a factor for each of its three values. Raking
scales the factors to each marginal in turn, saturated cells staying at 1 and
the others taking up the rest, until the expected sample meets the budget and
all targets, or nothing changes; the cells' inner structure stays as close to
the data as the targets allow. A value that has too few tokens for its target
at the budget is taken whole, and the other values of its dimension share what
it leaves in proportion to their targets. Wanted and reached shares are written
as the table `marginals`. A document is kept when a uniform
number drawn from a hash of its id lies below its cell's probability, so a
rerun, or the same document elsewhere, decides alike.

Targets name a bounded list of values per dimension; all other values (and
null) form one cell value, `OTHER`. So the cell table is bounded by the
product of the lists' lengths, and only it goes to the driver, which fits the
factors in numpy. The documents are read twice by DataFrame expressions, and
not shuffled. Columns n_tokens, topic, p and kept of the input are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SPACES, Scratch, unused

OTHER = "*"
DIMENSIONS = ("source", "lang", "topic")
#: Largest number of cells (product of the targets' lengths).
MAX_CELLS = 1_000_000
#: Raking ends when a round moves no marginal by more than this share of the
#: sample, or after so many rounds (targets that contradict each other at the budget).
CLOSE = 1e-9
ROUNDS = 1000
#: Bounds of a factor.
SMALLEST, LARGEST = 1e-90, 1e90


def token_count(text: Column | str) -> Column:
    """Words of a text at ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def shape_topic(text: Column | str, tokens: Column | str) -> Column:
    """A topic by the text's form: contact details, loud, short, long or prose."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return (F.when(F.contains(text, F.lit("@")), "contact").when(F.contains(text, F.lit("!!")), "loud")
            .when(tokens < 100, "short").when(tokens >= 1000, "long").otherwise("prose"))


def _named(column: str, values) -> Column:
    return F.when(F.col(column).isin(sorted(values)), F.col(column)).otherwise(F.lit(OTHER)) if values else F.lit(OTHER)


def cells(docs: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """docs (source, lang, topic, n_tokens) -> (source, lang, topic, t)."""
    dims = [_named(d, targets[d]).alias(d) for d in DIMENSIONS]
    return docs.select(*dims, "n_tokens").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("t"))


def _level(size: np.ndarray, u: np.ndarray, goal: float) -> float:
    """f with sum(size * min(1, f * u)) = goal; all at 1 if that is not enough."""
    if not len(size):
        return 1.0
    by = np.argsort(-u, kind="stable")
    size, u = size[by], u[by]
    full = np.concatenate([[0.0], np.cumsum(size)[:-1]])        # tokens of the cells saturated before
    rest = np.cumsum((size * u)[::-1])[::-1]
    f = np.maximum(goal - full, 0.0) / rest
    fits = np.flatnonzero(f * u <= 1)
    return float(f[fits[0]]) if len(fits) else float(1 / u[-1])


def calibrate(rows: list, targets: Mapping[str, Mapping[str, float]], budget: float) -> tuple[dict, list]:
    """From all cells (source, lang, topic, t) with tokens: factor of each value
    by dimension, and (dimension, value, wanted, reached) shares of the sample."""
    rows = sorted(tuple(r) for r in rows)
    size = np.array([r[3] for r in rows], float)
    need, names, which, places, wanted, goals = budget * size.sum(), [], [], [], [], []
    for k, d in enumerate(DIMENSIONS):
        values = sorted({r[k] for r in rows})
        number = {v: j for j, v in enumerate(values)}
        at = np.array([number[r[k]] for r in rows], int)
        there = np.bincount(at, size, len(values))
        want = np.array([float(targets[d].get(v, there[j] / size.sum())) for j, v in enumerate(values)])
        want /= want.sum()
        ask = np.maximum(want, 1e-300)
        goals.append(there * np.minimum(1.0, _level(there, ask / there, need) * ask / there))
        names.append(values)
        which.append(at)
        places.append([np.flatnonzero(at == j) for j in range(len(values))])
        wanted.append(want)
    factors = [np.ones(len(v)) for v in names]
    raw = lambda: factors[0][which[0]] * factors[1][which[1]] * factors[2][which[2]]
    reached = lambda k: np.bincount(which[k], size * np.minimum(raw(), 1.0), len(names[k]))
    last = [np.full(len(v), np.inf) for v in names]
    for _ in range(ROUNDS if rows else 0):
        for k in range(3):
            u = raw()
            for j, cells_of in enumerate(places[k]):
                factors[k][j] = np.clip(factors[k][j] * _level(size[cells_of], u[cells_of], goals[k][j]), SMALLEST, LARGEST)
        now = [reached(k) for k in range(3)]
        if max(np.abs(a - b).max() for a, b in zip(now, last)) <= CLOSE * need:
            break
        last = now
    if rows:        # where targets contradict each other, the budget is met all the same
        factors[0] *= _level(size, raw(), need)
    report = [(d, v, float(w), float(x / max(x_all, 1e-300))) for k, d in enumerate(DIMENSIONS) if rows
              for got in [reached(k)] for x_all in [got.sum()] for v, w, x in zip(names[k], wanted[k], got)]
    return {d: dict(zip(names[k], map(float, factors[k]))) for k, d in enumerate(DIMENSIONS)}, report


def _factors_of(factors: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for d in DIMENSIONS:
        pairs = [F.lit(x) for item in factors[d].items() for x in item]
        out = out * F.element_at(F.create_map(*pairs), F.col(d)) if pairs else out
    return F.least(out, F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) by the id (the text where that is null) and the seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], budget: float, seed: int = 1) -> DataFrame:
    """`docs` (doc_id, text, source, lang, any others) with n_tokens, topic, p
    and kept added: kept documents are the sample. Documents without tokens
    weigh nothing and are kept (p = 1)."""
    if not 0 < budget <= 1:
        raise ValueError("budget must be in (0, 1]")
    size = 1
    for d in DIMENSIONS:
        size *= len(targets[d]) + 1
    if size > MAX_CELLS:
        raise ValueError(f"targets span {size} cells, more than {MAX_CELLS}")
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = docs.withColumn("n_tokens", token_count("text")).withColumn("topic", shape_topic("text", "n_tokens"))
    table = scratch.write(cells(counted, targets), "cells")
    table = table.where("t > 0")
    factors, report = calibrate(table.collect(), targets, budget)
    fields = "array<struct<dimension:string,value:string,wanted:double,reached:double>>"
    said = F.from_json(F.lit(json.dumps([dict(zip(("dimension", "value", "wanted", "reached"), r)) for r in report])), fields)
    scratch.write(docs.sparkSession.range(1).select(F.inline(said)), "marginals")
    fitted = scratch.write(table.select(*DIMENSIONS, _factors_of(factors).alias("p")).coalesce(1), "fitted")
    *names, p = unused(counted, *[f"lw_{d}" for d in DIMENSIONS], "lw_p")
    probs = fitted.select(*[F.col(d).alias(n) for d, n in zip(DIMENSIONS, names)], F.col("p").alias(p))
    keyed = counted.withColumns({n: _named(d, targets[d]) for d, n in zip(DIMENSIONS, names)})
    out = keyed.join(scratch.small(probs, "fitted"), names, "left").withColumn("p", F.coalesce(p, F.lit(1.0)))
    return out.withColumn("kept", uniform(F.col("doc_id"), F.col("text"), seed) < F.col("p")).select(
        *[c for c in docs.columns if c not in ("n_tokens", "topic", "p", "kept")], "n_tokens", "topic", "p", "kept")
