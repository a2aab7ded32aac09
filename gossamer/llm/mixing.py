"""Mixing sources to target weights: raking in SQL windows, then calibrated sampling. JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.session import materialize, table

#: Cells up to this many are broadcast to the documents; beyond it the join is shuffled.
BROADCAST_CELLS = 100_000
#: The query's tempering exponents: a target share is in proportion to observed share ** exponent.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 20
#: Share of all tokens that a sample is expected to hold.
BUDGET = 0.8
#: Rounds between two writes of the cell table.
CHUNK = 4
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """The query's topic column: what form a text has."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains("|"), "table").when(t.contains("{") | t.contains("http"), "markup").when(t.contains("!!"), "shout").when(t.contains("\n"), "prose").otherwise("line")


def unit_draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; a null id draws as 'null'."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Wanted shares of a dimension's values; values that are not named get none.
Targets = dict[str, dict[str, float]]


def rake(cells: DataFrame, exponents: dict[str, float], rounds: int = ROUNDS, targets: Targets | None = None) -> DataFrame:
    """Iterative proportional fitting of ``tokens`` per cell to one marginal a dimension.

    ``cells`` has one row per combination of the dimensions, so its size follows the number of
    sources, languages and topics, not the documents; it is held in one partition, where the
    window sums need no exchange. Null dimension values are a value of their own. Cells without
    tokens keep weight 0. A dimension's marginal is the observed share to the power of its exponent or, where
    ``targets`` names the dimension, the shares given there over the values that have tokens.
    Adds ``weight`` (sums to 1).
    """
    targets = targets or {}
    one = Window.partitionBy()
    by = {d: Window.partitionBy(d) for d in exponents}
    total = F.sum("tokens").over(one)
    out = cells.coalesce(1).withColumn("weight", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
    for d, x in exponents.items():
        share = F.sum("weight").over(by[d])
        wanted = F.create_map(*[F.lit(v) for kv in targets[d].items() for v in kv]) if d in targets else None
        power = F.pow(f"_s_{d}", F.lit(x)) if wanted is None else F.coalesce(F.try_element_at(wanted, F.col(d).cast("string")), F.lit(0.0))
        out = out.withColumn(f"_s_{d}", share).withColumn(f"_p_{d}", F.when(F.col(f"_s_{d}") > 0, power).otherwise(F.lit(0.0)))
        part = F.when(F.col(f"_s_{d}") > 0, F.col(f"_p_{d}") * F.col("weight") / F.col(f"_s_{d}")).otherwise(F.lit(0.0))
        out = out.withColumn(f"_t_{d}", F.col(f"_p_{d}") / F.sum(part).over(one)).drop(f"_s_{d}", f"_p_{d}")
    for r in range(rounds):
        for d in exponents:
            now = F.sum("weight").over(by[d])
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_t_{d}") / now).otherwise(F.lit(0.0)))
        if r % CHUNK == CHUNK - 1:
            out = materialize(out, "rake").coalesce(1)
    return out.drop(*[f"_t_{d}" for d in exponents])


def cell_rates(docs: DataFrame, exponents: dict[str, float], rounds: int = ROUNDS, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    """The cells with ``tokens``, raked ``weight`` and ``rate``, as ``mixing_rates`` defines it."""
    cells = materialize(docs.groupBy(*exponents).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "cells")
    raked = rake(cells, exponents, rounds, targets)
    # cells by falling ratio: if all before one are taken whole, the rest shares what is left
    order = Window.orderBy(F.col("ratio").desc_nulls_last(), *exponents)
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    out = out.withColumn("scale", F.when(rest > 0, (F.lit(budget) * F.sum("tokens").over(Window.partitionBy()) - before) / rest)).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("scale") * F.col("ratio") <= 1, F.struct("place", "scale"))).over(Window.partitionBy()).scale
    return out.withColumn("rate", F.coalesce(F.least(F.lit(1.0), first * F.col("ratio")), F.lit(1.0))).select(*exponents, "tokens", "weight", "rate")


def mixing_rates(docs: DataFrame, exponents: dict[str, float], rounds: int = ROUNDS, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    """One row per cell with ``rate``: the calibrated inclusion probability of its documents.

    The rate is min(1, s * weight / tokens), with the s at which the expected tokens are ``budget``
    of all: where no cell is too scarce for its weight, expected tokens meet the raked marginals;
    scarce cells are taken whole, and the marginals are missed by what they lack: ``marginals``
    tells by how much. Cells without tokens have rate 1.
    """
    return cell_rates(docs, exponents, rounds, budget, targets).select(*exponents, "rate")


def marginals(docs: DataFrame, exponents: dict[str, float] | None = None, rounds: int = ROUNDS, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    """(dimension, value, observed, target, reached, residual): shares of all tokens, in the raked weights, and expected of the sample.

    ``residual`` is what the sample lacks of the target. ``whole`` is how many of the value's ``cells`` are taken whole.
    """
    exponents = exponents or EXPONENTS
    cells = materialize(cell_rates(docs, exponents, rounds, budget, targets), "cell-rates")
    each = cells.select("tokens", "weight", "rate", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in exponents])).alias("x"))
    sums = each.groupBy("x.dimension", "x.value").agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"), F.sum(F.col("tokens") * F.col("rate")).alias("r"), F.count_if((F.col("rate") >= 1) & (F.col("tokens") > 0)).alias("whole"), F.count_if(F.col("tokens") > 0).alias("cells"))
    part = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy("dimension"))
    return sums.select("dimension", "value", part("t").alias("observed"), part("w").alias("target"), part("r").alias("reached"), (part("w") - part("r")).alias("residual"), "whole", "cells")


def mix(docs: DataFrame, exponents: dict[str, float] | None = None, rounds: int = ROUNDS, budget: float = BUDGET, id_col: str = "doc_id", targets: Targets | None = None) -> DataFrame:
    """Adds (or replaces) ``rate`` and ``kept``; the dimensions of ``exponents`` and ``n_tokens`` must be columns.

    Every row of ``docs`` comes back, also ones with null dimensions or ids; rows of one id share
    their draw. All other columns stay, whatever their names. An empty table stays empty; texts are not read, so their length does not matter. The hot source costs nothing here: sums are partial, the cells are broadcast.
    """
    exponents = exponents or EXPONENTS
    rates = materialize(mixing_rates(docs, exponents, rounds, budget, targets), "rates")
    small = rates.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    # names that the documents have not, whatever they have
    mark = "_"
    while any(c.lower().startswith(f"{mark}mix_") for c in docs.columns):
        mark += "_"
    side = rates.select(*[F.col(d).alias(f"{mark}mix_{d}") for d in exponents], F.col("rate").alias(f"{mark}mix_rate"))
    on = None
    for d in exponents:
        c = docs[d].eqNullSafe(side[f"{mark}mix_{d}"])
        on = c if on is None else on & c
    out = docs.join(F.broadcast(side) if small else side, on, "inner").withColumn("rate", F.col(f"{mark}mix_rate")).drop(f"{mark}mix_rate", *[f"{mark}mix_{d}" for d in exponents if d != "rate"])
    return out.withColumn("kept", unit_draw(F.col(id_col)) < F.col("rate"))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), n_words(F.col("text")).alias("n_tokens"))
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", (F.floor(F.col("rate") * 1e6 + 0.5) / 1e6).alias("rate"), "kept")


def mixing_sql(docs: str, exponents: dict[str, float] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """CTEs ``mix_0 ... mix_rates`` over a relation with the dimensions and n_tokens."""
    exponents = exponents or EXPONENTS
    dims = list(exponents)
    ctes = [f"mix_c AS (SELECT {', '.join(dims)}, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM {docs} GROUP BY ALL)", "mix_w AS (SELECT *, CASE WHEN sum(tokens) OVER () > 0 THEN tokens / sum(tokens) OVER () ELSE 0.0 END AS weight FROM mix_c)"]
    shares = ", ".join(f"sum(weight) OVER (PARTITION BY {d}) AS s_{d}" for d in dims)
    ctes.append(f"mix_s AS (SELECT *, {shares} FROM mix_w)")
    targets = ", ".join(f"CASE WHEN s_{d} > 0 THEN pow(s_{d}, {x}) ELSE 0 END / sum(CASE WHEN s_{d} > 0 THEN pow(s_{d}, {x}) * weight / s_{d} ELSE 0 END) OVER () AS t_{d}" for d, x in exponents.items())
    ctes.append(f"mix_0 AS MATERIALIZED (SELECT {', '.join(dims)}, tokens, weight, {targets} FROM mix_s)")
    n = 0
    keep = ", ".join([*dims, "tokens", *[f"t_{d}" for d in dims]])
    for _ in range(rounds):
        for d in dims:
            ctes.append(f"mix_{n + 1} AS MATERIALIZED (SELECT {keep}, CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0 END AS weight FROM mix_{n})")
            n += 1
    ratio = "CASE WHEN tokens > 0 THEN weight / tokens END"
    order = f"ORDER BY ratio DESC NULLS LAST, {', '.join(d + ' NULLS FIRST' for d in dims)}"
    ctes.append(f"mix_q AS (SELECT *, {ratio} AS ratio FROM mix_{n})")
    ctes.append(f"mix_b AS (SELECT *, row_number() OVER ({order}) AS place, coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS total FROM mix_q)")
    ctes.append(f"mix_l AS (SELECT *, CASE WHEN rest > 0 THEN ({budget} * total - taken) / rest END AS scale FROM mix_b)")
    ctes.append("mix_f AS (SELECT arg_min(scale, place) AS s FROM mix_l WHERE scale * ratio <= 1)")
    ctes.append(f"mix_rates AS (SELECT {', '.join(dims)}, CASE WHEN (SELECT s FROM mix_f) * ratio < 1 THEN (SELECT s FROM mix_f) * ratio ELSE 1.0 END AS rate FROM mix_l)")
    return ",\n".join(ctes)


def draw_sql(doc_id: str = "doc_id", seed: str = SEED) -> str:
    return f"(CAST('0x' || substr(md5(CAST({doc_id} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


TOPIC_SQL = "CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN contains(coalesce(text, ''), '{') OR contains(coalesce(text, ''), 'http') THEN 'markup' WHEN contains(coalesce(text, ''), '!!') THEN 'shout' WHEN contains(coalesce(text, ''), chr(10)) THEN 'prose' ELSE 'line' END"
WORDS_SQL = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"

OP2_SQL = f"""
WITH mix_docs AS (SELECT doc_id, source, lang, {TOPIC_SQL} AS topic, {WORDS_SQL} AS n_tokens FROM documents),
{mixing_sql('mix_docs')}
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, floor(rate * 1e6 + 0.5) / 1e6 AS rate, {draw_sql()} < rate AS kept
FROM mix_docs d JOIN mix_rates r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic IS NOT DISTINCT FROM r.topic
"""
