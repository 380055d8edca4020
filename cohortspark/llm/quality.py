"""Quality rules: two fixed rules and a robust multivariate outlier test.

Every text becomes a vector of transformed statistics. For each language and source the
centre and scatter of the vectors are estimated by minimum covariance determinant: from several
starts at coordinate-wise quantiles (``STARTS``), concentration steps keep the ``SHARE`` of the
group with the smallest Mahalanobis distances and estimate again from those. A start goes on
while its determinant falls, and of a group's starts the one with the smallest determinant wins.
``SHARE`` is the half-set, so junk of up to nearly half of a group's texts stays outside the
estimate; ``CONSISTENCY`` scales the scatter of the half to that of all of a normal group. A
text whose distance from its group's estimate is beyond ``CUTOFF`` is rejected.

A step is one pass over all starts that still fall: rows are aggregated to counts and moments per
group, start and distance bin, on the map side first, and the kept share is a running count over
the bins. So a hot source adds bins, not rows, to a task. Variances have a floor, under which no
determinant can fall, so the steps end by themselves. The winners are shrunk towards those of the
language with a weight of ``PRIOR_ROWS`` rows, so small, empty or constant groups are no special
case.

Null or empty text has no words and fails the base rules. Null language and source form groups
of their own (together with the empty string). Repeated rows are judged one by one, but each
distinct text counts once per group in the estimates (copies are merged by SHA-256, on the map
side first), so a group of copies has no weight. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.scratch import stored

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
WINDOW = 5

SHARE = 0.5
STARTS = (0.25, 0.5, 0.75)  # quantiles
LEAST_FALL = 1e-3  # of a logarithm of a determinant
PRIOR_ROWS = 50.0
# chi-squared with 5 degrees of freedom: 4.351 is the 0.5 quantile; P(chi2_7 <= 4.351) = 0.261
CONSISTENCY = SHARE / 0.261
CUTOFF = 30.86  # 0.99999 quantile of chi-squared with 5 degrees of freedom
SMOOTHING = 20.0
TYPICAL_WORD = 5.5
RATE_OFFSET = 0.03
# statistic -> least standard deviation; also the scale of the first distances
FLOORS = {"word_length": 0.10, "symbol_rate": 0.40, "shout_rate": 0.40, "repeat_rate": 0.40,
          "line_rate": 0.40}
DIMS = tuple(FLOORS)
BINS = 40  # distance bins per natural logarithm


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def occurrences(text: Column, marks: str) -> Column:
    return (F.length(text) - F.length(without(text, marks))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: without(line, SPACES) != "")
    return bind(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text."""
    def hashes(ws: Column) -> Column:
        last = F.size(ws) - window
        return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(window)))))

    def places(hs: Column) -> Column:
        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def again(o: Column, x: Column, k: Column) -> Column:
            near = [F.get(o, F.greatest(k - 1, F.lit(0))), F.get(o, k + 1)]
            same = [F.coalesce(y["h"] == x["h"], F.lit(False)) for y in near]
            return ((k > 0) & same[0]) | same[1]

        return bind(ordered, lambda o: F.array_sort(F.transform(
            F.filter(o, lambda x, k: again(o, x, k)), lambda x: x["i"])))

    def covered(ps: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("at"))
        return F.aggregate(
            ps, start,
            lambda s, p: F.struct(
                (s["n"] + F.least(F.lit(window), p - s["at"])).cast("long").alias("n"),
                p.alias("at")),
            lambda s: s["n"])

    return bind(bind(words, hashes), lambda hs: F.when(
        F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long"))
        .otherwise(covered(places(hs))))


def text_statistics(text: Column) -> Column:
    """The counts of one text as a struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    return bind(words, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(without(text, SPACES)).cast("long").alias("word_chars"),
        occurrences(text, SYMBOLS).alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        (occurrences(text, string.ascii_uppercase + "!")).alias("n_shouts"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines")))


def base_failed(s: Column) -> Column:
    return ((s["n_words"] < LEAST_WORDS)
            | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"]))


def transformed(s: Column) -> dict[str, Column]:
    """The vector of a text: logarithms of smoothed rates, calm for short texts."""
    n = s["n_words"] + SMOOTHING
    rate = lambda count, of: F.log(count / of + RATE_OFFSET)
    return {
        "word_length": F.log((s["word_chars"] + SMOOTHING * TYPICAL_WORD) / n),
        "symbol_rate": rate(s["n_symbols"], n),
        "shout_rate": rate(s["n_shouts"], n),
        "repeat_rate": rate(s["n_repeat_words"], n),
        "line_rate": rate(s["n_dup_lines"], s["n_lines"] + SMOOTHING),
    }


def vectors(docs: DataFrame, text: str, lang: str, source: str, keep: list[Column]) -> DataFrame:
    """``keep``, the group, the counts and the transformed vector of every row."""
    counted = docs.select(*keep, F.coalesce(F.col(lang), F.lit("")).alias("g_lang"),
                          F.coalesce(F.col(source), F.lit("")).alias("g_source"),
                          F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("copy"),
                          text_statistics(F.col(text)).alias("s"))
    s = F.col("s")
    return counted.withColumns({"failed": base_failed(s), **{
        f"x_{d}": v for d, v in transformed(s).items()}})


PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[:i + 1]]
GROUP = ["g_lang", "g_source"]

# An estimate holds arrays, not a column a number: a step is planned again and again, and the
# driver's time and memory for it grow with its columns.  ``centre`` follows ``DIMS``; ``scatter``
# and ``inverse`` (the inverse Cholesky factor) hold lower triangles, as ``PAIRS`` lists them.
CENTRES = [f"m_{d}" for d in DIMS]
SCATTERS = [f"c_{a}_{b}" for a, b in PAIRS]
SHAPE = CENTRES + SCATTERS
FITTED = ["inverse", "centre"]


def at(triangle: Column, row: Column | int, column: Column | int) -> Column:
    """A number of a lower triangle."""
    place = row * (row + 1) / 2 + column
    return F.get(triangle, F.lit(place).cast("int"))


def packed(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the columns of ``SHAPE`` as ``centre`` and ``scatter``."""
    return df.select(*keep, F.array(*CENTRES).alias("centre"), F.array(*SCATTERS).alias("scatter"))


def quantiles(rows: DataFrame, shares: tuple[float, ...], width: float = 0.01) -> DataFrame:
    """Coordinate-wise quantiles per group, a row per share, from counts of cells of ``width``."""
    cells = rows.select(*GROUP, F.explode(F.array(*(F.struct(
        F.lit(d).alias("dim"), F.floor(F.col(f"x_{d}") / width).alias("cell"))
        for d in DIMS))).alias("c")).groupBy(*GROUP, "c.dim", "c.cell").agg(
        F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*GROUP, "dim")
    upto = by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(by)})

    def centre(share: float, d: str) -> Column:
        reached = (F.col("dim") == d) & (F.col("upto") >= share * F.col("all"))
        return ((F.min(F.when(reached, F.col("cell"))) + 0.5) * width).alias(f"m_{d}")

    return placed.groupBy(*GROUP).agg(F.array(*(
        F.struct(F.lit(k).alias("start"), *(centre(share, d) for d in DIMS))
        for k, share in enumerate(shares))).alias("starts")).select(*GROUP, F.inline("starts"))


def first_estimates(rows: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """The starts of each group, with the floors as scales."""
    scales = [1.0 / FLOORS[a] if a == b else 0.0 for a, b in PAIRS]
    shape = [FLOORS[a] ** 2 if a == b else 0.0 for a, b in PAIRS]
    return quantiles(rows, shares).select(
        *GROUP, "start", F.lit(True).alias("falls"), F.lit(0).cast("long").alias("n"),
        F.array(*CENTRES).alias("centre"), F.array(*map(F.lit, shape)).alias("scatter"),
        F.array(*map(F.lit, scales)).alias("inverse"), F.lit(float("inf")).alias("log_det"))


def squared_distance() -> Column:
    """Mahalanobis distance, from the inverse Cholesky factor of the group's scatter."""
    off = [F.col(f"x_{d}") - F.get("centre", F.lit(k)) for k, d in enumerate(DIMS)]
    parts = [reduce(add, (at(F.col("inverse"), i, j) * off[j] for j in range(i + 1)))
             for i in range(len(DIMS))]
    return reduce(add, (p * p for p in parts))


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: the next estimate and its determinant per group and start."""
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(f"x_{d}").alias(f"s_{d}") for d in DIMS]
    sums += [F.sum(F.col(f"x_{a}") * F.col(f"x_{b}")).alias(f"q_{a}_{b}") for a, b in PAIRS]
    binned = (rows.join(estimates.select(*GROUP, "start", *FITTED), GROUP)
              .withColumn("bin", F.floor(F.log(squared_distance() + 1e-6) * BINS))
              .groupBy(*GROUP, "start", "bin").agg(*sums))
    by = Window.partitionBy(*GROUP, "start")
    before = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = (binned.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)),
                                "all": F.sum("n").over(by)})
            .where(F.col("before") < SHARE * F.col("all")))
    names = ["n"] + [f"s_{d}" for d in DIMS] + [f"q_{a}_{b}" for a, b in PAIRS]
    half = near.groupBy(*GROUP, "start").agg(*(F.sum(c).alias(c) for c in names))
    centre, scatter = moments()
    return inverse_factor(half.select(*GROUP, "start", "n", centre.alias("centre"),
                                      scatter.alias("scatter")))


def moments() -> tuple[Column, Column]:
    """Means and scatter from the sums; the scatter corrected and floored."""
    n = F.col("n")
    mean = {d: F.col(f"s_{d}") / n for d in DIMS}
    cells = []
    for a, b in PAIRS:
        scatter = CONSISTENCY * (F.col(f"q_{a}_{b}") / n - mean[a] * mean[b])
        cells.append(F.greatest(scatter, F.lit(0.0)) + FLOORS[a] ** 2 if a == b else scatter)
    return F.array(*mean.values()), F.array(*cells)


def improved(estimates: DataFrame, following: DataFrame) -> DataFrame:
    """``estimates``, replaced where the following one has a smaller determinant."""
    values = ["n", "centre", "scatter", "inverse", "log_det"]
    fresh = following.select(*GROUP, "start", *(F.col(c).alias(f"new_{c}") for c in values))
    falls = F.coalesce(F.col("new_log_det") < F.col("log_det") - LEAST_FALL, F.lit(False))
    return estimates.join(fresh, [*GROUP, "start"], "left").select(
        *GROUP, "start", falls.alias("falls"),
        *(F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def least_determinant(estimates: DataFrame) -> DataFrame:
    """The start with the smallest determinant of each group."""
    best = F.min_by(F.struct("n", "centre", "scatter", "log_det"), F.struct("log_det", "start"))
    return estimates.groupBy(*GROUP).agg(best.alias("b")).select(
        *GROUP, "b.n", *(F.get("b.centre", F.lit(k)).alias(c) for k, c in enumerate(CENTRES)),
        *(F.get("b.scatter", F.lit(k)).alias(c) for k, c in enumerate(SCATTERS)), "b.log_det")


def shrunk(winners: DataFrame) -> DataFrame:
    """Each group's centre and scatter moved towards those of all of its language's half-sets."""
    lang, n = Window.partitionBy("g_lang"), F.col("n")
    mean = lambda value: F.sum(n * value).over(lang) / F.sum(n).over(lang)
    wide = winners.withColumns({f"w_m_{d}": mean(F.col(f"m_{d}")) for d in DIMS})
    between = {(a, b): (F.col(f"m_{a}") - F.col(f"w_m_{a}")) * (F.col(f"m_{b}") - F.col(f"w_m_{b}"))
               for a, b in PAIRS}
    wide = wide.withColumns({f"w_c_{a}_{b}": mean(F.col(f"c_{a}_{b}") + CONSISTENCY * between[a, b])
                             for a, b in PAIRS})
    weight = n / (n + PRIOR_ROWS)
    return packed(wide.select(*GROUP, *(
        (weight * F.col(c) + (1 - weight) * F.col(f"w_{c}")).alias(c) for c in SHAPE)), GROUP)


def inverse_factor(shaped: DataFrame) -> DataFrame:
    """Add the inverse Cholesky factor of each scatter and the logarithm of its determinant."""
    places = F.array(*(F.struct(F.lit(i).alias("row"), F.lit(j).alias("column"),
                                F.lit(FLOORS[a] ** 2 / 4).alias("least"))
                       for i, a in enumerate(DIMS) for j in range(i + 1)))
    none = F.array().cast("array<double>")

    def following(value):
        """Numbers are found in the order of the triangle, each from those before it."""
        return lambda found, p: F.concat(found, F.array(value(found, p["row"], p["column"], p["least"])))

    def factor(found: Column, i: Column, j: Column, least: Column) -> Column:
        start = lambda row: (row * (row + 1) / 2 + 1).cast("int")
        products = F.zip_with(F.slice(found, start(i), j), F.slice(found, start(j), j),
                              lambda x, y: x * y)
        rest = F.aggregate(products, at(F.col("scatter"), i, j), lambda left, x: left - x)
        return F.when(i == j, F.sqrt(F.greatest(rest, least))).otherwise(rest / at(found, j, j))

    def inverse(found: Column, i: Column, j: Column, least: Column) -> Column:
        own = at(F.col("factor"), i, i)
        total = F.aggregate(F.sequence(j, i - 1), F.lit(0.0),
                            lambda sum_, k: sum_ + at(F.col("factor"), i, k) * at(found, k, j))
        return F.when(i == j, 1 / own).otherwise(-total / own)

    log_det = 2 * reduce(add, (F.log(at(F.col("factor"), i, i)) for i in range(len(DIMS))))
    return shaped.withColumn("factor", F.aggregate(places, none, following(factor))).withColumns({
        "inverse": F.aggregate(places, none, following(inverse)), "log_det": log_det,
    }).drop("factor")


def concentrated(fair: DataFrame, shares: tuple[float, ...] = STARTS) -> DataFrame:
    """All starts of all groups, each after its last step that made its determinant smaller."""
    estimates = stored(first_estimates(fair, shares), "quality-start")
    while not estimates.where("falls").isEmpty():
        following = concentrate(fair, estimates.where("falls"))
        estimates = stored(improved(estimates, following), "quality-step")
    return estimates


def fit(rows: DataFrame) -> DataFrame:
    """Estimates per language and source from the distinct texts that pass the base rules."""
    fair = stored(rows.where(~F.col("failed")).groupBy(*GROUP, "copy").agg(
        *(F.first(f"x_{d}").alias(f"x_{d}") for d in DIMS)).drop("copy"), "quality-texts")
    winners = least_determinant(concentrated(fair))
    return stored(inverse_factor(shrunk(winners)).select(*GROUP, *FITTED), "quality-fit")


def verdict(rows: DataFrame, estimate: DataFrame, cutoff: float) -> DataFrame:
    """Add ``distance`` and ``kept``; a group without estimate holds only failed rows."""
    return (rows.join(estimate, GROUP, "left")
            .withColumn("distance", squared_distance())
            # one condition on both sides of the join: alone, that on ``failed`` would go below it
            # and have the statistics of each text computed again
            .withColumn("kept", F.coalesce(F.when(~F.col("failed"), F.col("distance")) <= cutoff,
                                           F.lit(False))))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang",
          source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``docs``: key, counts, base_failed, kept, distance (squared)."""
    rows = stored(vectors(docs, text, lang, source, [F.col(key).alias("doc_key")]),
                  "quality-rows")
    judged = verdict(rows, fit(rows), cutoff)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("doc_key").alias(key), *(f"s.{c}" for c in counts),
                         F.col("failed").alias("base_failed"), "kept", "distance")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang",
              source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged; text is never shuffled."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    fitted = fit(stored(vectors(docs, text, lang, source, []), "quality-rows"))
    rows = vectors(docs, text, lang, source, [row])
    return verdict(rows, fitted, cutoff).where("kept").select("row.*")
