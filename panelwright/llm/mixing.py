"""Mixing sources to target weights: token weights raked to source, language and topic marginals, then sampling.

The corpus is summed into cells of source, language and topic. Iterative proportional fitting scales the cells'
weights to one target marginal after the other until all hold, where a document is kept with the probability
min(1, weight): the fitting counts cells at probability 1 as they are, so that the targets hold under that cap too.
A hash of the document's id decides, so that every run and every executor decides alike. Many cells are raked as a
table instead of an array, by the same steps, in the same order, to the same tolerance.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, fresh_folder, only
from panelwright.llm.quality_mcd import WORD

#: Cells that are raked on the driver and broadcast; more are raked as a table and joined.
DRIVER_CELLS = 50_000
DIMENSIONS = ("source", "lang", "topic")
NOTHING = "(null)"
#: Of what a value has, the most that a target made by tempering asks for; and the factor of the budget where targets can't be met.
REACHED, LOWERED = 0.98, 0.95


def form_topic(text: Column) -> Column:
    """A topic by form, where a corpus has no topics: table, markup, shouting, prose or empty."""
    content = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(F.trim(content)) == 0, "empty")
        .when(content.contains(" | "), "table")
        .when(content.rlike(r"(?:[#$%&*]{3}[^#$%&*]{1,40}){3}"), "markup")
        .when(content.contains("!!"), "shouting")
        .otherwise("prose")
    )


def rake(tokens: np.ndarray, places: list[np.ndarray], wanted: list[np.ndarray], weights: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """(weights by which the sums of tokens * min(1, weight) by value are as wanted, the greatest gap left, as a share of all).

    places: for each dimension the number of each cell's value; wanted: a sum for each value. A step scales the weights
    of one dimension's values by Newton's rule, which is plain proportional fitting where no weight is over 1.
    """
    whole = max((w.sum() for w in wanted), default=0.0) or 1.0
    gap = 0.0
    for _ in range(rounds):
        gap = 0.0
        for place, want in zip(places, wanted):
            capped = weights >= 1
            sure = np.bincount(place, tokens * capped, len(want))
            rest = np.bincount(place, tokens * weights * ~capped, len(want))
            now = sure + rest
            gap = max(gap, float((np.abs(now - want) * (now > 0)).max(initial=0.0)) / whole)
            newton = np.divide(want - sure, rest, out=np.zeros(len(want)), where=rest > 0)
            plain = np.divide(want, now, out=np.zeros(len(want)), where=now > 0)
            scale = np.where(newton > 0, newton, np.where((rest <= 0) & (want >= now), 1.0, plain))
            weights = weights * scale[place]
        if gap < tolerance:
            break
    return weights, gap


def rake_table(cells: DataFrame, wanted: Mapping[str, DataFrame], rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """rake() for more cells than a driver should hold: cells (dimensions, tokens, weight), wanted (value, want).

    A sum by value combines before the shuffle. Rounds are written and read again, as a checkpoint would hand on
    estimates of sizes that each join multiplies.
    """
    whole = max((t.agg(F.sum("want").alias("s")).first()["s"] or 0.0 for t in wanted.values()), default=0.0) or 1.0
    gap = 0.0
    for _ in range(rounds):
        cells = cells.withColumn("gap", F.lit(0.0))
        for name, want in wanted.items():
            capped = F.col("weight") >= 1
            sums = cells.groupBy(name).agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double").alias("sure"), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("rest"))
            sums = sums.join(want.withColumnRenamed("value", name), name, "left").withColumns({"want": F.coalesce("want", F.lit(0.0)), "now": F.col("sure") + F.col("rest")})
            newton, plain = F.try_divide(F.col("want") - F.col("sure"), "rest"), F.coalesce(F.try_divide("want", "now"), F.lit(0.0))
            scale = F.when((F.col("rest") > 0) & (newton > 0), newton).when((F.col("rest") <= 0) & (F.col("want") >= F.col("now")), 1.0).otherwise(plain)
            far = F.when(F.col("now") > 0, F.abs(F.col("now") - F.col("want")) / whole).otherwise(0.0)
            cells = cells.join(sums.select(name, scale.alias("scale"), far.alias("far")), name).withColumns({"weight": F.col("weight") * F.col("scale"), "gap": F.greatest("gap", "far")}).drop("scale", "far")
        place = fresh_folder(cells.sparkSession, "raking")
        cells.write.parquet(place)
        cells = cells.sparkSession.read.parquet(place)
        gap = cells.agg(F.max("gap").alias("gap")).first()["gap"] or 0.0
        if gap < tolerance:
            break
    return cells.drop("gap"), gap


def reachable(totals: np.ndarray, power: float, budget: float) -> np.ndarray:
    """Shares in proportion to the totals' powers, none above what the value has of so many tokens in all; the others take up the rest."""
    own = np.where(totals > 0, totals, 1.0) ** power * (totals > 0)
    share, most = own / (own.sum() or 1.0), REACHED * totals / max(budget, 1e-300)
    full = np.zeros(len(totals), bool)
    while True:
        left = max(1 - most[full].sum(), 0.0)
        out = np.where(full, most, share * (left / (share[~full].sum() or 1.0)))
        new = full | (out > most)
        if (new == full).all():
            return out
        full = new


def reachable_table(totals: DataFrame, power: float, budget: float) -> DataFrame:
    """reachable() for a table of value and tokens: value and target."""
    out = cut(totals.where("tokens > 0").select("value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("own"), (F.lit(REACHED) * F.col("tokens") / max(budget, 1e-300)).alias("most"), F.lit(False).alias("full")))
    while True:
        sums = out.agg(F.sum(F.when(~F.col("full"), F.col("own"))).alias("own"), F.sum(F.when(F.col("full"), F.col("most"))).alias("most")).first()
        target = F.when(F.col("full"), F.col("most")).otherwise(F.col("own") * (max(1 - (sums["most"] or 0.0), 0.0) / (sums["own"] or 1.0)))
        new = out.withColumn("target", target)
        over = new.where("NOT full AND target > most")
        if over.isEmpty():
            return new.select("value", "target")
        out = cut(new.withColumn("full", F.col("full") | (F.col("target") > F.col("most"))).drop("target"))


def raked_cells(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, power: float, budget: float, rounds: int, tolerance: float, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """cells (dimensions, tokens) with a column weight; see mix_sources()."""
    spark, given = cells.sparkSession, {d: t for d, t in (targets or {}).items() if t}
    sizes = cells.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    n, total = sizes["n"], float(sizes["t"] or 0)
    if not total:
        return cells.withColumn("weight", F.lit(float(budget)))
    schema = ", ".join(f"{d} string" for d in DIMENSIONS) + ", tokens long, weight double"
    wish = budget * total
    if n <= driver_cells:
        rows = cells.select(*DIMENSIONS, "tokens").collect()  # at most driver_cells rows
        tokens = np.array([r["tokens"] for r in rows], float)
        places, names, sums = [], [], []
        for d in DIMENSIONS:
            names.append(sorted({r[d] for r in rows}))
            at = {v: i for i, v in enumerate(names[-1])}
            places.append(np.array([at[r[d]] for r in rows], np.int64))
            sums.append(np.bincount(places[-1], tokens, len(names[-1])))
        shares = {d: np.array([given[d].get(v, 0.0) for v in values]) for d, values in zip(DIMENSIONS, names) if d in given}
        for d, s in zip(DIMENSIONS, sums):
            if d in shares and (shares[d] > 0).any():
                wish = min(wish, float(np.min(s[shares[d] > 0] / shares[d][shares[d] > 0])))
        weights = np.full(n, wish / total)
        while True:
            wanted = [shares[d] * wish if d in shares else reachable(s, power, wish) * wish for d, s in zip(DIMENSIONS, sums)]
            weights, gap = rake(tokens, places, wanted, weights, rounds, tolerance)
            if gap < tolerance or wish < 1e-3 * budget * total:
                break
            wish, weights = wish * LOWERED, np.full(n, wish * LOWERED / total)
        _report(gap, tolerance)
        return spark.createDataFrame([(*[r[d] for d in DIMENSIONS], r["tokens"], float(w)) for r, w in zip(rows, weights)], schema)
    sums = {d: cut(cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("tokens"))) for d in DIMENSIONS}
    shares = {d: spark.createDataFrame([(v, float(x)) for v, x in given[d].items()], "value string, target double") for d in given}
    for d in shares:
        least = sums[d].join(shares[d].where("target > 0"), "value").agg(F.min(F.col("tokens") / F.col("target")).alias("m")).first()["m"]
        wish = min(wish, wish if least is None else least)
    while True:
        wanted = {d: (shares[d] if d in shares else reachable_table(sums[d], power, wish)).select("value", (F.col("target") * wish).alias("want")) for d in DIMENSIONS}
        raked, gap = rake_table(cells.select(*DIMENSIONS, "tokens").withColumn("weight", F.lit(wish / total)), wanted, rounds, tolerance)
        if gap < tolerance or wish < 1e-3 * budget * total:
            break
        wish *= LOWERED
    _report(gap, tolerance)
    return raked


def _report(gap: float, tolerance: float) -> None:
    if gap >= tolerance:
        warnings.warn(f"no weights meet the targets: a marginal is off by {gap:.3g} of the tokens", stacklevel=3)


def _keyed(docs: DataFrame, topic: Column, source: str, lang: str) -> list[Column]:
    named = {"source": docs[source], "lang": docs[lang], "topic": topic}
    return [F.coalesce(c.cast("string"), F.lit(NOTHING)).alias(f"mix_{d}") for d, c in named.items()]


def _decided(counted: DataFrame, doc_id: Column, targets, power: float, budget: float, seed: int, rounds: int, tolerance: float, driver_cells: int) -> DataFrame:
    """counted (with mix_source, mix_lang, mix_topic, mix_tokens) and its weight, probability and decision."""
    keys = [f"mix_{d}" for d in DIMENSIONS]
    cells = cut(counted.groupBy(*[F.col(k).alias(d) for k, d in zip(keys, DIMENSIONS)]).agg(F.sum("mix_tokens").alias("tokens")))
    raked = raked_cells(cells, targets, power, budget, rounds, tolerance, driver_cells).select(*[F.col(d).alias(k) for k, d in zip(keys, DIMENSIONS)], F.col("weight").alias("mix_weight"))
    few = raked.limit(driver_cells + 1).count() <= driver_cells
    place = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) / (1 << 52)
    out = counted.join(F.broadcast(raked) if few else raked, keys).withColumn("mix_probability", F.least(F.lit(1.0), "mix_weight"))
    return out.withColumn("mix_kept", place < F.col("mix_probability"))


def mix_sources(docs: DataFrame, topic: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping[str, Mapping[str, float]] | None = None, power: float = 0.7, budget: float = 0.5, seed: int = 17, rounds: int = 400, tolerance: float = 1e-9, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """doc_id, mix_source, mix_lang, mix_topic, mix_tokens, mix_weight, mix_probability, mix_kept, for each row of docs.

    Tokens are counted as words. budget: the share of all tokens to keep in expectation. targets: for "source", "lang"
    and "topic", a share for each value; values without one get none, and the budget is lowered until the shares can
    be met without a document kept twice. A dimension without targets gets its own shares, tempered by power, none of
    them above 0.98 of what its value has. If no weights meet all, the budget is lowered by twentieths, and a
    warning tells what gap is left if that doesn't help. Null sources, languages and topics are a value of their own, "(null)";
    null text has no tokens and its cell's probability. A null doc_id is hashed as such, repeated rows are decided
    alike, ties can't arise, other columns are ignored. An empty table gives an empty table. The words are counted once.
    """
    docs = only(docs, *dict.fromkeys([doc_id, text, source, lang]))
    words = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    counted = cut(docs.select(docs[doc_id].alias("doc_id"), *_keyed(docs, topic, source, lang), words.alias("mix_tokens")))
    return _decided(counted, F.col("doc_id"), targets, power, budget, seed, rounds, tolerance, driver_cells)


def keep_mixed(docs: DataFrame, topic: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: Mapping[str, Mapping[str, float]] | None = None, power: float = 0.7, budget: float = 0.5, seed: int = 17, rounds: int = 400, tolerance: float = 1e-9, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The rows of docs that mix_sources() keeps, with all their columns as they are, whatever their names."""
    words = F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"), *_keyed(docs, topic, source, lang), words.alias("mix_tokens"))
    return _decided(rows, F.col("mix_row")[doc_id], targets, power, budget, seed, rounds, tolerance, driver_cells).where("mix_kept").select("mix_row.*")
