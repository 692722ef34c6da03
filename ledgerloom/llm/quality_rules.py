"""Quality rules: robust multivariate outliers of statistics of texts, by language and source.

Counts of each text become a vector of four transformed ratios. For each language and source the minimum-covariance-determinant
location and scatter are estimated: from several starts (medians and spreads, random parts) concentration steps keep the rows
that are nearest by Mahalanobis distance, KEPT_SHARE of the group, and estimate from those anew; after two steps each group goes on
from the start of the least determinant, until that falls no more. A document whose squared distance is beyond CUTOFF is
rejected, as is one that fails the base rules. All of it is DataFrame functions. The bound of the nearest rows is a quantile
with a rank error of 1 / ACCURACY: exact for groups of fewer rows.

Null texts count as empty; null languages and sources are values of their own. A source of fewer than MIN_GROUP rows is
judged by the estimate of all rows of its language, a language of fewer by that of all rows of the table. Repeated rows and rows
without an id each get their row. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, unsettle

#: Rows that a language and source must have for an estimate of its own.
MIN_GROUP = 200
#: Share of a group that the concentration steps keep, and ranks that quantiles tell apart.
KEPT_SHARE = 0.75
ACCURACY = 10_000
#: Starts of a group: medians, and parts of about RANDOM rows by hash. Steps that each start makes, and most steps after those.
STARTS, RANDOM = 3, 50
FIRST, MOST_STEPS = 2, 15
#: Relative fall of the determinant that counts as one.
FALL = 1e-6
#: Groups whose estimates are sent to every executor, some 200 bytes each; more are joined by shuffle.
MOST_GROUPS = 20_000
#: Least spread of each coordinate: statistics that are constant over clean text tolerate that much.
FLOORS = (0.05, 0.15, 0.10, 0.10)
P = len(FLOORS)
#: A clean row of normal coordinates is beyond the cutoff with this probability.
BEYOND = 1e-9


def quantile(beyond: float) -> float:
    """Of the chi-squared distribution of four degrees of freedom, which is beyond x by exp(-x / 2) * (1 + x / 2)."""
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.exp(-mid / 2) * (1 + mid / 2) > beyond else (low, mid)
    return high


#: Squared distance beyond which a document is rejected, and the median, for consistency of scale.
CUTOFF, MEDIAN = quantile(BEYOND), quantile(0.5)

#: The counts of one text. Every array is bound to a lambda's variable, so that it is computed once.
COUNTS = r"""
transform(array(filter(split(__t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), ws -> named_struct(
  'n_words', cast(size(ws) as bigint),
  'n_repeat_words', if(size(ws) < 3, 0L, transform(array(transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))), hs ->
    if(size(array_distinct(hs)) = size(hs), 0L,
      transform(array(array_sort(transform(hs, (h, i) -> named_struct('h', h, 'a', ws[i], 'b', ws[i + 1], 'c', ws[i + 2], 'i', i)))), s ->
        transform(array(array_sort(filter(transform(s, (x, j) ->
            if((j > 0 and get(s, j - 1).h = x.h and get(s, j - 1).a = x.a and get(s, j - 1).b = x.b and get(s, j - 1).c = x.c)
               or (j + 1 < size(s) and get(s, j + 1).h = x.h and get(s, j + 1).a = x.a and get(s, j + 1).b = x.b and get(s, j + 1).c = x.c), x.i, null)), i -> i is not null))), p ->
          aggregate(transform(p, (x, j) -> if(j + 1 < size(p), least(3, p[j + 1] - x), 3)), 0L, (n, x) -> n + x))[0])[0]))[0])))[0]
"""
LINES = r"transform(array(filter(split(__t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), ls -> cast(size(ls) - size(array_distinct(ls)) as bigint))[0]"


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row."""
    text = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    full = text.select(
        "doc_id", "lang", "source", F.expr(COUNTS).alias("__s"), F.expr(LINES).alias("n_dup_lines"),
        F.expr(r"cast(char_length(regexp_replace(__t, '[\\x20\\x09-\\x0D]+', '')) as bigint)").alias("word_chars"),
        F.expr("cast(char_length(__t) - char_length(translate(__t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(char_length(__t) as bigint)").alias("__chars"),
    )
    return full.select("doc_id", "lang", "source", "__s.n_words", "word_chars", "n_symbols", "n_dup_lines", "__s.n_repeat_words", "__chars")


def _groups(feats: DataFrame) -> DataFrame:
    """feats with __g, the group that a row is judged by, and __in, the groups that it is part of."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.regexp_replace(c, "([/%])", "%$1")), F.lit("-"))
    by = feats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own, language, whole = F.concat(key("lang"), F.lit("/"), key("source")), F.concat(key("lang"), F.lit("/")), F.lit("*")
    of = Window.partitionBy("lang")
    by = by.withColumn("m", F.sum("n").over(of)).withColumn("least", F.min("n").over(of))
    by = settle(by.withColumn("judged", F.when(F.col("n") >= MIN_GROUP, own).when(F.col("m") >= MIN_GROUP, language).otherwise(whole)))
    rare = bool(by.where("judged = '*'").take(1))
    parts = F.array(F.when(F.col("n") >= MIN_GROUP, own), F.when((F.col("m") >= MIN_GROUP) & (F.col("least") < MIN_GROUP), language), F.when(F.lit(rare), whole))
    by = by.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("judged").alias("__g"), F.filter(parts, lambda x: x.isNotNull()).alias("__in"))
    return feats.join(by, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s"))).drop("__l", "__s")


def _vector(feats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return feats.withColumns({
        "x0": F.log((F.col("word_chars") + 1) / n),
        "x1": F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("__chars"), F.lit(1))),
        "x2": F.sqrt(F.col("n_dup_lines") / (n / 10.0 + F.col("n_dup_lines"))),
        "x3": F.sqrt(F.col("n_repeat_words") / n),
    })


MEANS = [f"m_{i}" for i in range(P)]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def _factor(stats: DataFrame) -> DataFrame:
    """stats (__g, m_i, c_i_j) as (__g, m_i, l_i_j, det): the Cholesky factor of the covariance, floors added to its diagonal, and its determinant."""
    for i, j in LOWER:
        left = F.col(f"c_{i}_{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
        for k in range(j):
            left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        stats = stats.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l_{j}_{j}"))
    det = F.pow(F.col("l_0_0") * F.col("l_1_1") * F.col("l_2_2") * F.col("l_3_3"), 2)
    return stats.select("__g", *MEANS, *(f"l_{i}_{j}" for i, j in LOWER), det.alias("det"))


def _moments(rows: DataFrame) -> DataFrame:
    """(__g, m_i, c_i_j): means and covariances of groups."""
    sums = rows.groupBy("__g").agg(*(F.avg(f"x{i}").alias(f"m_{i}") for i in range(P)), *(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s_{i}_{j}") for i, j in LOWER))
    return sums.select("__g", *MEANS, *((F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")).alias(f"c_{i}_{j}") for i, j in LOWER))


def _with(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows with a settled table of one row for each group, which is sent to all while it has MOST_GROUPS rows at most."""
    return rows.join(F.broadcast(small) if small.count() <= MOST_GROUPS else small, "__g")


def _distance(rows: DataFrame, stats: DataFrame) -> DataFrame:
    out = _with(rows, stats)
    for i in range(P):
        left = F.col(f"x{i}") - F.col(f"m_{i}")
        for k in range(i):
            left = left - F.col(f"l_{i}_{k}") * F.col(f"__y{k}")
        out = out.withColumn(f"__y{i}", left / F.col(f"l_{i}_{i}"))
    out = out.withColumn("__d", sum((F.col(f"__y{i}") ** 2 for i in range(1, P)), F.col("__y0") ** 2))
    return out.select(*rows.columns, "__d")


def _step(points: DataFrame, stats: DataFrame) -> DataFrame:
    """The estimate from the nearest rows by stats, settled; a group keeps stats if its determinant doesn't fall."""
    far = _distance(points, stats)
    near = settle(far.groupBy("__g").agg(F.percentile_approx("__d", KEPT_SHARE, ACCURACY).alias("__q")))
    after = _factor(_moments(_with(far, near).where("__d <= __q")))
    out = settle(stats.unionByName(after).groupBy("__g").agg(F.min_by(F.struct(*stats.columns), "det").alias("x")).select("x.*"))
    unsettle(near)
    return out


def _starts(points: DataFrame) -> DataFrame:
    """Estimates of each group from its starts, named __g#k, settled."""
    middle = points.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(f"x{i}", [0.16, 0.5, 0.84], ACCURACY).alias(f"q{i}") for i in range(P)))
    spread = lambda i: (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 2
    medians = middle.select(F.concat("__g", F.lit("#0")).alias("__g"), *(F.col(f"q{i}")[1].alias(f"m_{i}") for i in range(P)), *((spread(i) * spread(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in LOWER))
    sizes = settle(middle.select("__g", "n"))
    some = _with(points, sizes).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))))
    some = some.where(F.pmod(F.xxhash64("k", *(f"x{i}" for i in range(P))), F.greatest(F.lit(1), F.floor(F.col("n") / RANDOM))) == 0)
    parts = _moments(some.withColumn("__g", F.concat("__g", F.lit("#"), "k")).select(points.columns))
    out = settle(_factor(medians.unionByName(parts)))
    unsettle(sizes)
    return out


def estimates(points: DataFrame) -> DataFrame:
    """(__g, m_i, l_i_j, det): minimum-covariance-determinant estimates of the groups of points (__g, x_i)."""
    stats = _starts(points)
    each = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).withColumn("__g", F.concat("__g", F.lit("#"), "k")).drop("k")
    for _ in range(FIRST):
        before, stats = stats, _step(each, stats)
        unsettle(before)
    best = stats.withColumn("__g", F.regexp_replace("__g", "#[0-9]+$", ""))
    best = settle(best.groupBy("__g").agg(F.min_by(F.struct(*stats.columns), "det").alias("x")).select("x.*"))
    unsettle(stats)
    for _ in range(MOST_STEPS):
        before, best = best, _step(points, best)
        fell = before.select("__g", F.col("det").alias("__b")).join(best, "__g").where(F.col("det") < F.col("__b") * (1 - FALL)).take(1)
        unsettle(before)
        if not fell:
            break
    return best


def outliers(feats: DataFrame) -> DataFrame:
    """feats (columns of counts()) with distance: the squared robust Mahalanobis distance by the estimate that the row is judged by."""
    rows = settle(_vector(_groups(feats)))
    points = settle(rows.select(F.explode("__in").alias("__g"), *(f"x{i}" for i in range(P))))
    best = estimates(points)
    far = _distance(points, best)
    scale = settle(far.groupBy("__g").agg(F.greatest(F.percentile_approx("__d", 0.5, ACCURACY) / MEDIAN, F.lit(1.0)).alias("__c")))
    out = settle(_with(_distance(rows, best), scale).withColumn("distance", F.col("__d") / F.col("__c")).drop("__g", "__in", "__d", "__c", *(f"x{i}" for i in range(P))))
    unsettle(rows, points, best, scale)
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, distance and kept."""
    known = settle(counts(docs))
    out = outliers(known)
    unsettle(known)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"))
