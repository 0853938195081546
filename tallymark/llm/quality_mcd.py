"""Quality rules: base limits, and robust multivariate outliers for each language and source.

Statistics of each text become a vector of transformed values. Each group's location and scatter come from a minimum covariance
determinant estimate: from medians and median deviations, concentration steps take the COVERED half of the group with the least
distance and compute mean and covariance anew, until no group's determinant changes. So nearly half of a group can be junk of one
kind without drawing the estimate to it. A step is one pass: sums of values and products are kept for each group and class of
distance (classes are a 256th of an octave wide), and the nearest classes that hold half of the group, the last one as a
whole, give the next mean and covariance. A text is rejected if its squared Mahalanobis distance is beyond the cutoff.
Everything is in DataFrame functions; groups with few rows are judged by their language's estimate, or by that of all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import MAX_BROADCAST_GROUPS, group_join, table, words, written

COVERED = 0.5  # full breakdown: (n + p + 1) / 2 rows but for three at most
STEPS = 20  # at most, if a determinant still changes
SETTLED = 1e-3  # relative change of a determinant that counts as none
FEW = 200  # rows below which a group has no estimate of its own
LEVEL = 1e-20  # share of normal texts beyond the cutoff; so small since good texts are not normal: at 0.001 some 5 percent of them go


def chi2_cutoff(level: float) -> float:
    """The distance that a chi-square with five degrees of freedom exceeds with this probability, by bisection."""
    tail = lambda x: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > level else (low, middle)
    return high


CUTOFF = chi2_cutoff(LEVEL)  # of the squared distance, after scaling to the median of a chi-square
CHI2_MEDIAN = 4.351  # fixed value: median of a chi-square with five degrees of freedom
OCTAVE = 256  # classes of squared distance in which it doubles; with few, the last class of the half makes the steps cycle
SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\f\r"

#: Least standard deviation of each value that is taken for chance.
FLOORS = {"x_words": 0.5, "x_length": 0.08, "x_symbols": 0.4, "x_lines": 0.08, "x_repeats": 0.08}
X = list(FLOORS)


def base_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row; null text is empty."""
    text = F.col("__text")
    rows = df.select(F.col(id_col), *[F.col(c) for c in extra], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", words(text))
    word = F.col("__words")
    size = F.size(word)
    # Hashes only tell that no window is there twice; where two are alike the windows themselves are compared.
    hashed = F.transform(F.slice(word, 1, F.greatest(size - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        id_col,
        *extra,
        size.cast("long").alias("n_words"),
        F.length(F.translate(text, GAPS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.when(F.size(F.array_distinct(hashed)) < size - 2, word).alias("__words"),  # null where no window repeats
    )
    line, word = F.col("__lines"), F.col("__words")
    win = F.transform(F.slice(word, 1, F.greatest(F.size(word) - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(word, i + 1), F.get(word, i + 2)))
    ranked = F.array_sort(F.transform(win, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        """Words that windows with an equal neighbour in this order cover."""
        same = lambda x, j: F.coalesce(F.get(pairs, j)["s"] == x["s"], F.lit(False))
        hit = F.filter(pairs, lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
        at = F.array_sort(F.transform(hit, lambda x: x["i"]))
        return F.transform(F.array(at), lambda a: F.aggregate(F.transform(a, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(a, j + 1) - p, F.lit(3)))), F.lit(0), lambda x, y: x + y))[0]

    repeats = F.when(word.isNull(), 0).otherwise(F.transform(F.array(ranked), covered)[0])
    return rows.select(
        id_col, *extra, "n_words", "word_chars", "n_symbols", (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vectors() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(n).alias("x_words"),
        F.log(chars / n).alias("x_length"),
        F.log1p(1000 * F.col("n_symbols") / chars).alias("x_symbols"),
        F.log1p(10 * F.col("n_dup_lines") / n).alias("x_lines"),
        (F.col("n_repeat_words") / n).alias("x_repeats"),
    ]


def with_groups(rows: DataFrame, groups: DataFrame, few: bool | None = None) -> DataFrame:
    """rows joined with a table of one row a group; beyond the bound of a broadcast a group's rows go to several tasks."""
    return group_join(rows, groups, ["group"], X, few)


N = len(X)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]
MEANS = [f"m_{j}" for j in range(N)]
COVARIANCE = [f"c_{i}_{j}" for i, j in PAIRS]
FACTORS = [f"d_{j}" for j in range(N)] + [f"l_{i}_{j}" for i in range(N) for j in range(i)]


def factor_sql(source: str) -> str:
    """An LDL factorisation of the covariance, whose diagonal is floored; one query inside the other, so that no term is written out twice."""
    q = source
    for j, a in enumerate(X):
        less = "".join(f" - l_{j}_{k} * l_{j}_{k} * d_{k}" for k in range(j))
        q = f"(SELECT *, c_{j}_{j} + {FLOORS[a] ** 2!r}D{less} AS d_{j} FROM {q})"
        below = [f"(c_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k} * d_{k}" for k in range(j)) + f") / d_{j} AS l_{i}_{j}" for i in range(j + 1, N)]
        q = f"(SELECT {', '.join(['*', *below])} FROM {q})" if below else q
    return f"SELECT `group`, {', '.join(MEANS + FACTORS)} FROM {q}"


def distance_sql(source: str, keep: str) -> str:
    q = source
    for i, a in enumerate(X):
        q = f"(SELECT *, {a} - m_{i}{''.join(f' - l_{i}_{k} * y_{k}' for k in range(i))} AS y_{i} FROM {q})"
    return f"SELECT {keep}, {' + '.join(f'y_{i} * y_{i} / d_{i}' for i in range(N))} AS d2 FROM {q}"


def step_sql(near: str) -> str:
    """near(group, x..., m..., d2) to (group, m..., c...): mean and covariance of each group's nearest half, from sums by class of
    distance of the values' differences from the last mean, which lose no digits."""
    away = [f"({a} - m_{j})" for j, a in enumerate(X)]
    kept = ["n", *[f"s_{j}" for j in range(N)], *[f"q_{i}_{j}" for i, j in PAIRS]]
    sums = [f"sum({x}) AS s_{j}" for j, x in enumerate(away)] + [f"sum({away[i]} * {away[j]}) AS q_{i}_{j}" for i, j in PAIRS]
    first = [f"first({m}) AS {m}" for m in MEANS]
    parts = f"(SELECT `group`, floor(log2(greatest(d2, 1e-300D)) * {OCTAVE}) AS kind, count(*) AS n, {', '.join(first + sums)} FROM {near} GROUP BY ALL)"
    ordered = f"(SELECT *, sum(n) OVER (PARTITION BY `group` ORDER BY kind) - n AS before, sum(n) OVER (PARTITION BY `group`) AS every FROM {parts})"
    total = f"(SELECT `group`, {', '.join(first + [f'sum({c}) AS {c}' for c in kept])} FROM {ordered} WHERE before < {COVERED}D * every GROUP BY `group`)"
    new = [f"m_{j} + s_{j} / n AS m_{j}" for j in range(N)] + [f"q_{i}_{j} / n - s_{i} / n * s_{j} / n AS c_{i}_{j}" for i, j in PAIRS]
    return f"(SELECT `group`, {', '.join(new)} FROM {total})"


FACTOR, STEP = factor_sql("{est}"), factor_sql(step_sql(f"({distance_sql('{near}', ', '.join(['`group`', *X, *MEANS]))})"))


def distances(rows: DataFrame, est: DataFrame, few: bool | None = None) -> DataFrame:
    """rows with d2, the squared distance to their group's estimate; null for a group without one."""
    return rows.sparkSession.sql(distance_sql("{near}", ", ".join(f"`{c}`" for c in rows.columns)), near=with_groups(rows, est, few))


def stepped(rows: DataFrame, est: DataFrame, few: bool) -> DataFrame:
    """The next estimate of each group: mean and covariance of its half that is nearest to the last one."""
    return rows.sparkSession.sql(STEP, near=with_groups(rows.select("group", *X), est, few))


def estimates(rows: DataFrame) -> DataFrame:
    """rows(group, x...) to (group, factors, scale): the estimate of each group and what its distances are divided by."""
    spark = rows.sparkSession
    middle = written(rows.groupBy("group").agg(*[F.percentile_approx(a, 0.5, 1000).alias(m) for m, a in zip(MEANS, X)]), "medians")
    few = middle.count() <= MAX_BROADCAST_GROUPS
    spread = with_groups(rows, middle, few).groupBy("group").agg(*[F.first(m).alias(m) for m in MEANS], *[F.percentile_approx(F.abs(F.col(a) - F.col(m)), 0.5, 1000).alias(f"s_{j}") for j, (m, a) in enumerate(zip(MEANS, X))])
    start = spread.select("group", *MEANS, *[(F.pow(1.4826 * F.col(f"s_{i}"), 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS])
    est = written(spark.sql(FACTOR, est=start), "estimate")
    log = " + ".join(f"ln({{t}}.d_{j})" for j in range(N))
    change = f"SELECT 1 FROM {{old}} a JOIN {{new}} b ON a.`group` = b.`group` WHERE abs({log.format(t='a')} - ({log.format(t='b')})) > {SETTLED}D LIMIT 1"
    for _ in range(STEPS):
        new = written(stepped(rows, est, few), "estimate")
        settled = not spark.sql(change, old=est, new=new).head(1)
        est = new
        if settled:
            break
    scale = distances(rows, est, few).groupBy("group").agg((F.percentile_approx("d2", 0.5, 1000) / F.lit(CHI2_MEDIAN)).alias("scale"))
    return written(est.join(scale, "group").withColumn("scale", F.greatest("scale", F.lit(0.05))), "estimate")


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(id, base statistics, base_failed, distance, kept) of each row.

    Null text: no words, so it fails the base. Null languages and sources are groups of their own. Repeated rows each count. Ties
    at a limit are all inside it. Very long texts are read whole; memory is one text and its words. distance is null where base_failed; groups of fewer than FEW rows take the estimate of their
    language, languages of fewer that of all rows, and with no rows that passed the base nothing is rejected. Other columns are
    not carried. An empty table gives an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"))
    stats = base_statistics(rows, "id", "t", ("lang", "source")).withColumn("base_failed", base_failed())
    stats = written(stats.select("*", *vectors()), "statistics")
    passed = stats.filter("not base_failed")
    groups = {"own": F.concat_ws("\1", "lang", "source"), "lang": F.col("lang"), "all": F.lit("")}
    leveled = passed.select(F.explode(F.array(*[F.concat(F.lit(k + "\2"), g) for k, g in groups.items()])).alias("group"), *X)
    sizes = written(leveled.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    wanted = sizes.filter((F.col("n") >= FEW) | F.col("group").startswith("all\2")).select("group")
    est = estimates(with_groups(leveled, wanted.withColumn("held", F.lit(True))).filter("held").drop("held"))
    # The finest group of each (language, source) that has an estimate.
    keys = {k: F.concat(F.lit(k + "\2"), g).alias(f"key_{k}") for k, g in groups.items()}
    named = passed.select(groups["own"].alias("of"), *keys.values()).distinct()
    for k in groups:
        named = named.join(est.select(F.col("group").alias(f"key_{k}"), F.col("group").alias(f"has_{k}")), f"key_{k}", "left")
    chosen = named.select("of", F.coalesce(*[f"has_{k}" for k in groups]).alias("group"))
    est_of = written(chosen.join(est, "group").drop("group").withColumnRenamed("of", "group"), "chosen")
    near = distances(stats.withColumn("group", F.concat_ws("\1", "lang", "source")), est_of.drop("scale"))
    near = with_groups(near, est_of.select("group", "scale"))
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))
    return near.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), kept.alias("kept"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).withColumn("distance", F.round("distance", 4))
