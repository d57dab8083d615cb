"""Quality rules: word statistics by fixed rules, and robust multivariate outliers among them. DataFrame functions only.

The statistics of a document become a vector of logarithms. For each language and source the minimum-covariance-
determinant estimate is found by concentration steps from two starts, medians with absolute deviations and means with
the plain covariance: the share of documents with the least Mahalanobis distances is taken, its mean and covariance
are the next estimate, and so on until no determinant changes; the lesser determinant wins. Estimates are broadcast
where the counted groups are few, else joined by salted keys, so that a hot group's rows stay spread. Vectors are
rounded to thousandths and summed as whole numbers, and the cut between near and far documents is an exact percentile
of rounded distances, so that results don't depend on how rows are dealt out, and each step moves one row per group
and task. A fixed floor keeps the covariance regular where most documents have no symbols or repeats at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import cut, only

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SCALE = 1000
#: The group of all documents; a language's and a source's begin with a brace.
CORPUS = ""
#: Groups up to which a table with one row a group is broadcast; beyond, a group's rows meet it under so many salts.
FEW_GROUPS, SALTS = 20_000, 32
VARIABLES = ("words", "length", "symbols", "lines", "repeats")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class McdSettings:
    """share: of a group's documents that the estimate rests on. floors: least standard deviation of each variable.
    steps: concentration steps at most; they end when no logarithm of a determinant changes by more than settled."""

    share: float = 0.75
    steps: int = 12
    settled: float = 1e-6
    confidence: float = 0.9999
    least_group: int = 40
    floors: tuple[float, ...] = (0.25, 0.1, 0.4, 0.5, 0.6)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chi_square_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma function of (k / 2, x / 2), by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more; equal windows have equal 64-bit hashes, others differ but for a chance of 2**-64."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        at = let(ordered, places)
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        sums = F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).cast("long").alias("n")), lambda s: s["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(sums)

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, and with the five statistics of the whole text (null: none); equal columns are replaced."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words"))

    out = docs.withColumn("_w", let(F.regexp_extract_all(content, F.lit(WORD), F.lit(0)), of_words))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(content, r"[^#*$%&|<>]+", "")).cast("long"))
    out = out.withColumn("n_dup_lines", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
    for name in ("n_words", "word_chars", "n_repeat_words"):
        out = out.withColumn(name, F.col(f"_w.{name}"))
    return out.drop("_w", text)


def _vector() -> list[Column]:
    """The transformed statistics, in whole thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / words),
        F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.log1p(100 * F.col("n_dup_lines") / words),
        F.log1p(100 * F.col("n_repeat_words") / words),
    )
    return [F.round(x * SCALE).cast("long").alias(f"x_{v}") for v, x in zip(VARIABLES, raw)]


def _root(estimate: DataFrame, settings: McdSettings, factor: float) -> DataFrame:
    """Adds the lower triangular root l_ij of factor * covariance (c_ij) plus the squared floors."""
    n = len(VARIABLES)
    for i in range(n):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") * factor + (settings.floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            estimate = estimate.withColumn(f"l_{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}_{j}"))
    return estimate


def _with_group(rows: DataFrame, groups: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows joined with the rows of a small table by grp, without gathering a group's rows in one task."""
    if few:
        return rows.join(F.broadcast(groups), "grp", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["grp", "salt"], how).drop("salt")


def _distances(rows: DataFrame, estimate: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under their group's estimate."""
    out = _with_group(rows, estimate, few, how)
    for i, v in enumerate(VARIABLES):
        z = F.col(f"x_{v}") / SCALE - F.col(f"m_{i}")
        for k in range(i):
            z = z - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(VARIABLES))), F.col("z_0") * F.col("z_0")))


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean m_i and covariance c_ij of the vectors by keys, from sums of whole numbers."""
    n, names = len(VARIABLES), [f"x_{v}" for v in VARIABLES]
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(names)]]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i in range(n) for j in range(i + 1)]
    mean = [(F.col(f"s_{i}") / F.col("n") / SCALE).alias(f"m_{i}") for i in range(n)]
    moment = [(F.col(f"q_{i}_{j}") / F.col("n") / SCALE**2 - F.col(f"s_{i}") / F.col("n") / SCALE * F.col(f"s_{j}") / F.col("n") / SCALE).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, *mean, *moment)


def _estimate(rows: DataFrame, settings: McdSettings, few: bool) -> DataFrame:
    """One row a group: mean m_i and root l_ij of the covariance of the documents it rests on, corrected for their choice."""
    n, p = len(VARIABLES), settings.share
    names = [f"x_{v}" for v in VARIABLES]
    middle = rows.groupBy("grp").agg(*[F.percentile(F.round(F.col(x), -1), F.lit(0.5)).alias(f"mid_{i}") for i, x in enumerate(names)])
    spread = _with_group(rows, cut(middle), few).groupBy("grp", *[f"mid_{i}" for i in range(n)]).agg(*[F.percentile(F.abs(F.round(F.col(x), -1) - F.col(f"mid_{i}")), F.lit(0.5)).alias(f"mad_{i}") for i, x in enumerate(names)])
    robust = [(F.col(f"mid_{i}") / SCALE).alias(f"m_{i}") for i in range(n)]
    robust += [(F.pow(F.col(f"mad_{i}") * 1.4826 / SCALE, F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(n) for j in range(i + 1)]
    starts = spread.select("grp", F.lit(0).alias("start"), *robust).unionByName(_moments(rows, "grp").withColumn("start", F.lit(1)))
    size = 2 * sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, n)), F.log(F.col("l_0_0")))
    estimate = cut(_root(starts, settings, 1.0).withColumn("size", size))
    factor = p / chi_square_cdf(chi_square_quantile(p, n), n + 2)
    for _ in range(settings.steps):
        far = _distances(rows, estimate, few).select("grp", "start", *names, F.round(F.log(F.col("d2") + 1e-6) * 200).alias("far"))
        cuts = far.groupBy("grp", "start").agg(F.percentile("far", F.lit(p)).alias("most"))
        near = _with_group(far, cuts.withColumnRenamed("start", "of"), few).where("start = of AND far <= most")
        new = _root(_moments(near, "grp", "start"), settings, factor).withColumn("size", size)
        new = cut(new.join(estimate.select("grp", "start", F.col("size").alias("before")), ["grp", "start"]))
        moved = new.agg(F.max(F.abs(F.col("size") - F.col("before"))).alias("moved")).first()["moved"]
        estimate = new.drop("before")
        if moved is None or moved <= settings.settled:
            break
    rest = [c for c in estimate.columns if c not in ("grp", "size", "start")]
    best = F.min_by(F.struct(*rest), F.struct(F.round("size", 9), "start")).alias("best")
    return cut(estimate.groupBy("grp").agg(best).select("grp", "best.*"))


def quality_outliers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", settings: McdSettings = McdSettings()) -> DataFrame:
    """One row for each row of docs: doc_id, the five statistics, base_failed, kept, distance.

    base_failed: fewer than 50 words, or more than half of them in repeated windows. The other documents form groups by
    language and source (null is a value of its own). Documents of a group of fewer than least_group are judged by the
    estimate of all sound documents of their language, and if these are still too few, by that of all sound documents;
    so each has a distance. kept: not base_failed, and a squared distance within the chi-square quantile of the
    confidence. Null text counts as empty; null doc_ids and
    repeated rows stay as they are; other columns are ignored; an empty table gives an empty table.
    """
    rows = only(docs, doc_id, text, lang, source).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = word_statistics(rows)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = cut(rows.withColumn("base_failed", failed).select("*", *_vector()))
    sound = rows.where("NOT base_failed")
    named = F.struct(F.coalesce(F.to_json(F.struct("lang")), F.lit("")).alias("lang"), F.coalesce(F.to_json(F.struct("source")), F.lit("")).alias("source"))
    sizes = sound.groupBy(named.alias("own")).agg(F.count("*").alias("n"))
    least = F.lit(settings.least_group)
    langs = cut(sizes.groupBy(F.col("own.lang").alias("lang")).agg(F.sum("n").alias("n_lang"), F.max(F.col("n") < least).alias("lends")))
    corpus = langs.agg(F.coalesce(F.max(F.col("n_lang") < least), F.lit(False)).alias("all_lend"))
    sizes = sizes.join(langs, F.col("own.lang") == F.col("lang")).crossJoin(corpus)
    alone, together = F.col("n") >= least, F.col("n_lang") >= least
    grp = F.when(alone, F.to_json("own")).when(together, F.col("lang")).otherwise(CORPUS)
    # a row counts in its own group, and in those of its language and of the corpus if a smaller one falls back on them
    serves = F.filter(F.array(F.when(alone, F.to_json("own")), F.when(together & F.col("lends"), F.col("lang")), F.when(F.col("all_lend"), F.lit(CORPUS))), lambda g: g.isNotNull())
    sizes = cut(sizes.select("own", grp.alias("grp"), serves.alias("serves")))
    few = sizes.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    by_own = lambda what, how: _with_group(what.withColumn("grp", named), sizes.select(F.col("own").alias("grp"), F.col("grp").alias("judged_by"), "serves"), few, how)
    grouped = cut(by_own(sound, "inner").select(F.explode("serves").alias("grp"), *[f"x_{v}" for v in VARIABLES]))
    estimate = _estimate(grouped, settings, few)
    placed = by_own(rows, "left").drop("grp", "serves").withColumnRenamed("judged_by", "grp")
    far = _distances(placed, estimate, few, "left")
    distance = F.when(~F.col("base_failed"), F.sqrt("d2"))
    limit = math.sqrt(chi_square_quantile(settings.confidence, len(VARIABLES)))
    return far.select("doc_id", *STATISTICS, "base_failed", (~F.col("base_failed") & (F.sqrt("d2") <= limit)).alias("kept"), distance.alias("distance"))
