"""Quality rules: text statistics, and robust multivariate outliers among them.

Only DataFrame functions are used. The statistics of a text are taken within
its row, so texts are neither exploded nor shuffled. Four of them, transformed
to be near normal, make a vector. For each language and source, minimum
covariance determinant estimates of place and scatter are found by
concentration steps: the share ``COVERAGE`` of the rows with the smallest
Mahalanobis distances gives the next estimates. There are two deterministic
starts, medians with median deviations and means with standard deviations; per
group, the one that comes to the smaller determinant is carried on. All steps
are sums and quantile sketches per group, so a group may hold any share of the
rows. Symbols, repeated lines and repeated words are zero in most texts, where
the estimated scatter is none at all: a direction's scatter is ``FLOOR`` at
least, about what a few occurrences make in a short text. Only directions below
it are set by it; nothing is added to the others, and the word length, which
every text has, is left to the estimate (its floor only keeps from dividing by
zero). The factor that makes distances consistent, larger or smaller than one,
is taken from and applied to the directions that aren't floored.

Statistics of few words vary more, so estimates are made by ``LENGTHS`` of texts
too. Each squared distance is held against ``CUTOFF``, the 0.9999 quantile of
chi-square with four degrees. In a length, sources (then languages, then the
length itself) of fewer than ``LEAST_ROWS`` texts are pooled.

Nulls: a null text has no words and fails; null ``lang`` and ``source`` are
values of their own. Repeated rows count each. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

COVERAGE = 0.75
STEPS = 2
LEAST_ROWS = 50
#: Words from which texts are of the next length.
LENGTHS = (50, 100, 200)
#: Standard deviations that each transformed statistic has at least, given those before it.
FLOOR = {"word_length": 0.001, "symbols": 0.06, "dup_lines": 0.12, "repeats": 0.08}
FEATURES = list(FLOOR)
#: The 0.9999 quantile of chi-square with four degrees of freedom, and the medians with one to four.
CUTOFF, MEDIANS = 23.513, (0.45494, 1.38629, 2.36597, 3.35669)
ACCURACY = 2000


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of each row's text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
        F.array_remove(F.split(text, SPACES), "").alias("words"), F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    hashed = words.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    n = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    windows = hashed.withColumn("windows", F.transform(F.arrays_zip(*[F.slice("hashes", k + 1, n).alias(f"h{k}") for k in range(WINDOW)]), lambda s: F.xxhash64(s))).drop("hashes")
    return windows.withColumn("n_repeat_words", repeat_words(F.col("windows"))).drop("windows")


def repeat_words(windows: Column) -> Column:
    """Words in windows found twice or more, from the hashes of all windows in order."""
    n = F.size(windows)
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = F.filter(F.arrays_zip(F.slice(order, 1, n - 1).alias("a"), F.slice(order, 2, n - 1).alias("b")), lambda p: p["a"]["h"] == p["b"]["h"])
    places = F.array_distinct(F.flatten(F.transform(near, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda i: F.sequence(i, i + (WINDOW - 1)))))
    return F.when(F.size(F.array_distinct(windows)) < n, F.size(covered)).otherwise(0).cast("long")


def vectors(stats: DataFrame) -> DataFrame:
    """``stats`` with the transformed statistics; they are null for texts without words."""

    def share(part: str, whole: str) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1)))))

    some = F.col("n_words") > 0
    made = {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }
    return stats.withColumns({k: F.when(some, v) for k, v in made.items()})


def _groups(rows: DataFrame) -> DataFrame:
    """``rows`` with ``group``: language, source and length; what is too rare for estimates of its own is pooled."""
    rows = rows.withColumn("length", sum((F.col("n_words") >= n).cast("int") for n in LENGTHS))
    size = rows.groupBy("length", "lang", "source").agg(F.count("*").alias("size"))
    langs = size.groupBy("length", "lang").agg(F.sum("size").alias("lang_size"))
    lengths = size.groupBy("length").agg(F.sum("size").alias("length_size"))
    own_length, own_lang, own_source = F.col("length_size") >= LEAST_ROWS, F.col("lang_size") >= LEAST_ROWS, F.col("size") >= LEAST_ROWS
    same = (F.col("s.length") == F.col("l.length")) & F.col("s.lang").eqNullSafe(F.col("l.lang"))
    known = size.alias("s").join(langs.alias("l"), same).join(lengths.alias("n"), F.col("s.length") == F.col("n.length")).select(
        F.col("s.length").alias("k_length"), F.col("s.lang").alias("k_lang"), F.col("s.source").alias("k_source"),
        F.xxhash64(own_length, own_lang, own_source, F.when(own_length, F.col("s.length")), F.when(own_lang, F.col("s.lang")), F.lit("/"), F.when(own_source, F.col("s.source"))).alias("group"),
    )
    known = written(known)  # as a table of known size, so that a small one is broadcast and no group of rows is brought together
    same = (F.col("length") == F.col("k_length")) & F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    return rows.join(known, same).drop("k_length", "k_lang", "k_source", "length")


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _factored(estimates: DataFrame) -> DataFrame:
    """The Cholesky factor l_i_j of the scatter c_i_j, which directions are not floored (free_i), and the logarithm of the determinant."""
    out = estimates
    for i, j in _PAIRS:
        rest = F.col(f"c_{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        if i == j:
            low = FLOOR[FEATURES[i]] ** 2
            out = out.withColumn("rest", rest).withColumns({f"free_{i}": F.col("rest") > low, f"l_{i}_{i}": F.sqrt(F.greatest("rest", F.lit(low)))})
        else:
            # a floored direction isn't taken out of later ones
            out = out.withColumn(f"l_{i}_{j}", F.when(F.col(f"free_{j}"), rest / F.col(f"l_{j}_{j}")).otherwise(0.0))
    total = sum((F.log(f"l_{i}_{i}") for i in range(len(FEATURES))), F.lit(0.0))
    return out.withColumn("log_det", 2 * total).select("group", "log_det", *[f"{x}_{i}" for x in ("m", "free") for i in range(len(FEATURES))], *[f"l_{i}_{j}" for i, j in _PAIRS])


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, their squared Mahalanobis distances, and the part ``free`` of it in directions that aren't floored."""
    out = rows.join(estimates, "group")
    for i, name in enumerate(FEATURES):
        rest = F.col(name) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))  # columns, so that none is worked out again in the next
    squares = [F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(FEATURES))]
    free = sum((squares[i] * F.col(f"free_{i}").cast("double") for i in range(len(FEATURES))), F.lit(0.0))
    return out.withColumns({"d2": sum(squares, F.lit(0.0)), "free": free}).select(*rows.columns, "d2", "free")


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and scatter by group."""
    means = [F.avg(name).alias(f"m_{i}") for i, name in enumerate(FEATURES)]
    cov = [F.coalesce(F.covar_pop(FEATURES[i], FEATURES[j]), F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS]
    return rows.groupBy("group").agg(*means, *cov)


def _starts(rows: DataFrame) -> list[DataFrame]:
    medians = written(rows.groupBy("group").agg(*[F.percentile_approx(name, 0.5, ACCURACY).alias(f"m_{i}") for i, name in enumerate(FEATURES)]))
    off = rows.join(medians, "group")
    spread = off.groupBy("group").agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(len(FEATURES))],
        *[F.pow(1.4826 * F.percentile_approx(F.abs(F.col(name) - F.col(f"m_{i}")), 0.5, ACCURACY), 2).alias(f"c_{i}_{i}") for i, name in enumerate(FEATURES)],
    )
    robust = spread.withColumns({f"c_{i}_{j}": F.lit(0.0) for i, j in _PAIRS if i != j})
    return [written(_factored(robust)), written(_factored(_moments(rows)))]


def _concentrated(rows: DataFrame, estimates: DataFrame, steps: int) -> DataFrame:
    for _ in range(steps):
        near = _distances(rows, estimates)
        edge = written(near.groupBy("group").agg(F.percentile_approx("d2", COVERAGE, ACCURACY).alias("edge")))
        estimates = written(_factored(_moments(near.join(edge, "group").filter("d2 <= edge"))))
    return estimates


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant estimates by ``group``: m_i, the Cholesky factor l_i_j, and ``scale``, which makes distances in directions that aren't floored consistent."""
    first, second = (_concentrated(rows, start, STEPS) for start in _starts(rows))
    better = first.join(second.select("group", F.col("log_det").alias("other")), "group")
    chosen = better.filter("log_det <= other").drop("other").unionByName(second.join(better.filter("log_det > other").select("group"), "group", "left_semi"))
    best = _concentrated(rows, written(chosen), STEPS)
    n_free = sum(F.col(f"free_{i}").cast("int") for i in range(len(FEATURES)))
    middle = _distances(rows, best).groupBy("group").agg(F.percentile_approx("free", 0.5, ACCURACY).alias("middle"))
    scale = F.col("middle") / F.element_at(F.array(*map(F.lit, MEDIANS)), F.greatest(n_free, F.lit(1)))
    found = best.join(written(middle), "group").withColumn("scale", F.when((n_free > 0) & (F.col("middle") > 0), scale).otherwise(1.0))
    return written(found.drop("middle"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``distance`` (squared, scaled, null if base_failed) and ``kept``."""
    stats = written(vectors(statistics(docs)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed)
    fine = _groups(rows.filter("not base_failed"))
    found = estimates(fine.select("group", *FEATURES))
    near = _distances(fine, found).join(found.select("group", "scale"), "group").withColumn("distance", F.col("d2") - F.col("free") + F.col("free") / F.col("scale"))
    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = near.select(*names, "distance", (F.col("distance") <= CUTOFF).alias("kept"))
    return good.unionByName(rows.filter("base_failed").select(*names, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))
