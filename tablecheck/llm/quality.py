"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Texts are measured, a base rule rejects what is plainly no prose, and the rest is judged
by how far its measures lie from those of its language and source. Centre and spread are
minimum-covariance-determinant estimates: concentration steps keep the share of a group
that lies nearest, estimate again, and so on, from two starts; the estimate of the least
determinant counts. Sums are of whole numbers, so they do not depend on the order in which
tasks end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.helpers import SPACE_CLASS, named
from tablecheck.session import pin

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group that an estimate rests on, just over half, so that just under half of
#: a group may be junk; and concentration steps.
SHARE, STEPS = 0.51, 6
#: Quantile 0.5 of the chi-square distribution with as many degrees as there are measures,
#: and the squared distance beyond which a text is rejected (quantile 0.999999).
MEDIAN_CHI2, LIMIT = 4.351, 35.89
#: Measures are kept as whole multiples of this.
GRAIN = 1000
#: The least standard deviation of each measure, so that a group in which nearly all texts have
#: no symbol, say, does not reject every text with one.
FLOORS = (0.5, 0.05, 0.5, 1.0, 1.0)
D = len(FLOORS)
SYMBOLS = "[^#*$%&|<>]+"


def text_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with the numbers of the base rule.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, as described in
    ``robust_outliers``. Everything but the last is one pass; words of repeated 3-word
    windows are found by sorting the 64-bit hashes of a text's windows.
    """
    keep = [c for c in df.columns if c.lower() != text_col.lower()]
    text, words, windows, places = "_text", "_words", "_windows", "_places"
    spaces = F.lit(" \t\n\x0b\f\r")
    rows = df.select(*[named(c) for c in keep], F.coalesce(named(text_col), F.lit("")).alias(text))
    bare = F.btrim(F.col(text), spaces)
    none = F.array().cast("array<string>")
    rows = rows.withColumn(words, F.when(bare == "", none).otherwise(F.split(bare, SPACE_CLASS + "+")))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, spaces) != "")
    rows = rows.withColumn("_lines", lines)
    at = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(
        at, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(3)])
    )
    rows = rows.select(
        *[named(c) for c in keep], F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias(windows),
    )
    # Where no window repeats, which is usual for short texts, there is nothing to sort.
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    kind = "array<struct<h:bigint,i:int>>"
    rows = rows.withColumn(windows, F.when(some, pairs).otherwise(F.array().cast(kind)))
    same = lambda x, k: F.coalesce(F.get(F.col(windows), k)["h"] == x["h"], F.lit(False))
    repeated = F.filter(F.col(windows), lambda x, k: same(x, k - 1) | same(x, k + 1))
    rows = rows.withColumn(places, F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.transform(
        places, lambda p, k: F.least(F.coalesce(F.get(F.col(places), k + 1) - p, F.lit(3)), F.lit(3))
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", total).drop(windows, places)


def _measures() -> list[Column]:
    """The transformed vector, in whole multiples of 1 / GRAIN."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n),
    )
    return [F.round(v * GRAIN).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _least_share(value: str, share: float) -> Column:
    """How many of the n rows of each value are among the least ``share`` of a group's rows.

    For a frame of (grp, value, n); at most one value of a group is there in part.
    """
    before = Window.partitionBy("grp").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    left = F.ceil(share * F.sum("n").over(whole)) - F.coalesce(F.sum("n").over(before), F.lit(0))
    return F.least(F.col("n"), F.greatest(left, F.lit(0)))


def _medians(rows: DataFrame) -> DataFrame:
    """The lower median of each measure by group, from the counts of its values."""
    out = None
    for i in range(D):
        counts = rows.groupBy("grp", F.col(f"x{i}").alias("v")).agg(F.count("*").alias("n"))
        low = counts.withColumn("low", _least_share("v", 0.5)).where("low > 0")
        middle = low.groupBy("grp").agg(F.max("v").alias(f"m{i}"))
        out = middle if out is None else out.join(middle, "grp")
    return out


def _deviations(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """Start: medians as centre and median absolute deviations as a diagonal spread."""
    near = rows.join(medians, "grp")
    far = near.select("grp", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in range(D)])
    mads = _medians(far).select("grp", *[F.col(f"m{i}").alias(f"a{i}") for i in range(D)])
    spread = [
        (F.pow(1.4826 * F.col(f"a{i}"), 2) if i == j else F.lit(0.0)).cast("double").alias(f"c{i}{j}")
        for i in range(D) for j in range(i + 1)
    ]
    centre = [F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(D)]
    return medians.join(mads, "grp").select("grp", *centre, *spread)


def _factors(params: DataFrame) -> DataFrame:
    """Add the Cholesky factor of each group's spread, with the floors on its diagonal."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                floor = (FLOORS[i] * GRAIN) ** 2
                params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(0.0)) + floor))
            else:
                params = params.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return params.drop(*[f"c{i}{j}" for i in range(D) for j in range(i + 1)])


def _distance(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with their squared Mahalanobis distance ``d2``."""
    near = rows.join(_factors(params), "grp", how)
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        near = near.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = F.col("y0") * F.col("y0")
    for i in range(1, D):
        d2 = d2 + F.col(f"y{i}") * F.col(f"y{i}")
    return near.withColumn("d2", d2)


def _bin(d2: Column) -> Column:
    return F.round(F.log1p(d2) * GRAIN).cast("long")


def _concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Mean and spread of the share of each group that is nearest by ``params``.

    Moments are summed per bin of distance before the shuffle; which bins belong to
    the nearest share is decided on the bins. The rows of the bin at the cut count by the
    fraction of them that is needed, so many copies of one text do not come in as a whole.
    """
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    bins = _distance(rows, params).groupBy("grp", _bin(F.col("d2")).alias("bin")).agg(
        F.count("*").alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)],
        *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"p{i}{j}") for i, j in pairs],
    )
    near = bins.withColumn("near", _least_share("bin", SHARE)).where("near > 0")
    whole, part = F.col("near") == F.col("n"), F.col("near") / F.col("n")

    def total(name: str) -> Column:
        # One bin at most is there in part, so its product is no sum of fractions.
        cut = F.max(F.when(~whole, F.col(name).cast("double") * part))
        zero = F.lit(0.0)
        return (F.coalesce(F.sum(F.when(whole, F.col(name))).cast("double"), zero) + F.coalesce(cut, zero)).alias(name)

    sums = near.groupBy("grp").agg(
        F.sum("near").cast("double").alias("n"),
        *[total(f"s{i}") for i in range(D)], *[total(f"p{i}{j}") for i, j in pairs],
    )
    n = F.col("n")
    return sums.select(
        "grp", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(D)],
        *[(F.col(f"p{i}{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n).alias(f"c{i}{j}") for i, j in pairs],
    )


def _estimate(rows: DataFrame, steps: int) -> DataFrame:
    """Centre and spread of each group of ``rows``.

    One start is from all rows, one from the distinct vectors, among which copies of a text
    are one. Both are concentrated on all rows at once, as groups whose names begin with
    the number of the start. The lesser determinant stays, the first start at a tie.
    """
    start = lambda k: F.concat(F.lit(k), F.col("grp")).alias("grp")
    values = [F.col(f"x{i}") for i in range(D)]
    begin = pin(rows.select(start("0"), *values).unionAll(rows.distinct().select(start("1"), *values)), "starts")
    medians = pin(_medians(begin), "medians")
    params = pin(_deviations(begin, medians), "spread")
    twice = rows.select(F.explode(F.array(start("0"), start("1"))).alias("grp"), *values)
    for _ in range(steps):
        params = pin(_concentrate(twice, params), "spread")
    size = F.round(sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00")), 6)
    sized = params.join(_factors(params).select("grp", size.alias("size")), "grp")
    names = [c for c in params.columns if c != "grp"]
    best = sized.groupBy(F.substring("grp", 2, 1 << 30).alias("grp")).agg(
        F.min_by(F.struct(*names), F.struct("size", F.substring("grp", 1, 1))).alias("best")
    )
    return pin(best.select("grp", "best.*"), "spread")


def robust_outliers(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"), limit: float = LIMIT, steps: int = STEPS,
) -> DataFrame:
    """One row per row of ``df``: its id, measures, base_failed, kept and distance.

    Words are runs of anything but ASCII white space. word_chars counts their characters,
    n_symbols those of ``#*$%&|<>`` in the text, n_dup_lines the lines with a word that
    equal an earlier line, n_repeat_words the words in 3-word windows that the text has
    twice or more. base_failed: fewer than 50 words, or more than half of them repeated.

    The vector is the logarithms of words, characters a word, and symbols, repeated lines and
    repeated words per hundred words (these plus one). Estimates of a group, all
    rows with equal ``group_cols`` (nulls are equal), rest on the nearest SHARE of its rows
    that pass the base rule; up to some 45% of them may be junk, copies of one text too.
    ``distance`` is the squared Mahalanobis distance, scaled so that the group's median is that
    of the chi-square distribution; beyond ``limit`` a text is rejected. The spread of a
    measure has a floor (FLOORS), so equal texts, ties and groups of one row are no
    outliers. Rows that fail the base rule have no distance. Null texts have no words;
    repeated rows are measured each; an empty table gives no rows; other columns of ``df``
    do not matter and are not returned.
    """
    group = F.concat(*[
        F.coalesce(F.concat(F.lit("="), named(c).cast("string")), F.lit("")) if i == 0
        else F.concat(F.lit("\n"), F.coalesce(F.concat(F.lit("="), named(c).cast("string")), F.lit("")))
        for i, c in enumerate(group_cols)
    ]) if group_cols else F.lit("")
    measured = text_measures(df.select(named(id_col).alias("doc_id"), group.alias("grp"), named(text_col).alias("text")))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    table = pin(measured.withColumn("base_failed", failed).select("*", *_measures()), "measures")
    rows = table.where("not base_failed").select("grp", *[f"x{i}" for i in range(D)])
    params = _estimate(rows, steps)
    judged = _distance(table, params)
    bins = judged.where("not base_failed").groupBy("grp", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    low = bins.withColumn("low", _least_share("bin", 0.5)).where("low > 0")
    middle = low.groupBy("grp").agg(F.expm1(F.max("bin") / GRAIN).alias("middle"))
    # Never scaled up: a group of equal rows has no spread, and floors as its measure.
    scale = F.least(F.lit(1.0), MEDIAN_CHI2 / F.greatest(F.col("middle"), F.lit(1e-9)))
    known = params.join(middle, "grp")
    # Groups of which every row failed the base rule have no estimate.
    scored = _distance(table, known, "left").withColumn(
        "distance", F.when(~F.col("base_failed"), F.col("d2") * scale)
    )
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)).alias("kept"), "distance",
    )
