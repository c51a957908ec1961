"""Quality rules: base rules, and minimum-covariance-determinant outliers per language and source.

Everything is DataFrame expressions.  The statistic vector of a text is transformed to
scales on which clean texts are roughly normal; each group's centre and covariance are
those of the share of its texts whose covariance has the least determinant, found by
concentration steps from several starts; texts beyond a Mahalanobis distance from their
group's centre are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE, Workspace, lookup

SYMBOLS = "#*$%&|<>"
_DIMS = 5
#: Least spread of each statistic, in its transformed unit: texts that nearly all agree
#: on a statistic must not make a slight difference an outlier.
FLOORS = (0.5, 0.1, 0.4, 0.7, 0.3)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper) by row.

    Null texts have no words and no lines.  Each step's arrays stand in a projection of
    their own, because later steps read them more than once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    one = docs.select(F.col(id_col).alias("doc_id"), kept["lang"].alias("lang"), kept["source"].alias("source"), text.alias("text"))
    base = ["doc_id", "lang", "source"]
    two = one.select(*base, "text", F.array_remove(F.split("text", SPACE + "+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    counts = [
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.char_length("text") - F.char_length(F.translate("text", letters, ""))).cast("long").alias("n_upper"),
    ]
    three = two.select(*base, *counts, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    four = three.select(*base, *[c for c in three.columns if c.startswith(("n_", "word_"))], F.when(F.size("h") >= 8, F.transform(F.sequence(F.lit(0), F.size("h") - 8), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(8)]))).otherwise(F.array().cast("array<bigint>")).alias("win"))
    # Only texts with a repeated window go on: the windows sorted, those like a neighbour, their places in order.
    place = F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    five = four.withColumn("sorted", F.when(F.size(F.array_distinct("win")) < F.size("win"), place)).drop("win")
    near = F.filter("sorted", lambda e, j: (e["x"] == F.get("sorted", j - 1)["x"]) | (e["x"] == F.get("sorted", j + 1)["x"]))
    starts = F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(near, lambda e: e["i"])))
    six = five.withColumn("starts", starts).drop("sorted")
    covered = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + 8 - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + 8).alias("end")), lambda a: a["n"])
    return six.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    percent = lambda x, of: F.log1p(100 * x / of)
    return [F.log(words), F.log(chars / words), percent(F.col("n_symbols"), chars), percent(F.greatest(F.col("n_repeat_words"), F.col("n_dup_lines")), words), percent(F.col("n_upper"), chars)]


def _groups(stats: DataFrame, work: Workspace, least: int) -> DataFrame:
    """``stats`` with ``group``, whose estimate judges a text, and ``fits``, the groups that it helps to fit.

    The group is the text's language and source or, where fewer than ``least`` of its texts
    pass the base rules and so can be fitted to, all texts of the language or, where those
    are too few as well, all texts.
    """
    lang, source = (F.coalesce(c, F.lit("\x00")) for c in ("lang", "source"))
    keyed = stats.withColumns({"g1": F.concat_ws("\x01", lang, source), "g2": F.concat(lang, F.lit("\x01\x02"))})
    one = keyed.groupBy("g1", "g2").agg(F.count_if(~F.col("base_failed")).alias("n1"))
    two = one.groupBy("g2").agg(F.sum("n1").alias("n2"), F.min("n1").alias("least1"))
    three = two.agg(F.min(F.when(F.col("least1") < least, F.col("n2"))).alias("least2"))
    named = one.join(two, "g2").crossJoin(F.broadcast(three))
    everyone = F.lit("\x02")
    group = F.when(F.col("n1") >= least, F.col("g1")).when(F.col("n2") >= least, F.col("g2")).otherwise(everyone)
    own = F.when(F.col("n1") >= least, F.col("g1"))
    whole = F.when((F.col("least1") < least) & (F.col("n2") >= least), F.col("g2"))
    named = named.select("g1", group.alias("group"), F.array_compact(F.array(own, whole, F.when(F.col("least2") < least, everyone))).alias("fits"))
    return lookup(keyed.drop("g2"), work.save(named, "groups"), ["g1"], ["doc_id"]).drop("g1")


def chi_square(x: float, k: int) -> float:
    """The distribution function of chi-square with ``k`` degrees of freedom."""
    value, at = (math.erf(math.sqrt(x / 2)), 1) if k % 2 else (1 - math.exp(-x / 2), 2)
    while at < k:
        value, at = value - (x / 2) ** (at / 2) * math.exp(-x / 2) / math.gamma(at / 2 + 1), at + 2
    return value


def consistency(share: float, dims: int) -> float:
    """What the covariance of the closest ``share`` of normal vectors is multiplied by to be that of all."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < share else (low, middle)
    return share / chi_square(high, dims + 2)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(_DIMS) for j in range(i + 1)]


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(_DIMS)]
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(_DIMS)], *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _pairs()]]


def _parameters(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre m_i, the lower Cholesky factor l_i_j of the scaled covariance, and its determinant, of each group's sums.

    Variances are at least the squared floors, so the factor always exists.
    """
    n = F.col("n").cast("double")
    out = sums.select(*keys, *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_DIMS)], *[(scale * (F.col(f"s{i}_{j}") / n - F.col(f"s{i}") / n * (F.col(f"s{j}") / n))).alias(f"c{i}_{j}") for i, j in _pairs()])
    out = out.withColumns({f"c{i}_{i}": F.greatest(F.col(f"c{i}_{i}"), F.lit(FLOORS[i] ** 2)) for i in range(_DIMS)})
    for i, j in _pairs():
        rest = F.col(f"c{i}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}_{j}"))
    det = F.lit(1.0)
    for i in range(_DIMS):
        det = det * F.col(f"l{i}_{i}") * F.col(f"l{i}_{i}")
    return out.select(*keys, *[f"m{i}" for i in range(_DIMS)], *[f"l{i}_{j}" for i, j in _pairs()], det.alias("det"))


def _distance(joined: DataFrame) -> DataFrame:
    """With d2, the squared Mahalanobis distance from the group's centre, by forward substitution."""
    for i in range(_DIMS):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}_{k}") * F.col(f"y{k}")
        joined = joined.withColumn(f"y{i}", y / F.col(f"l{i}_{i}"))
    d2 = sum(F.col(f"y{i}") * F.col(f"y{i}") for i in range(_DIMS))
    return joined.withColumn("d2", d2).drop(*[f"y{i}" for i in range(_DIMS)], *[f"m{i}" for i in range(_DIMS)], *[f"l{i}_{j}" for i, j in _pairs()])


def _bin() -> Column:
    """A bin of d2 on a logarithmic scale, of which there are at most 400."""
    return F.least(F.greatest(F.floor(8 * F.log(F.col("d2") + 1e-12)), F.lit(-220)), F.lit(180)).cast("int")


def _concentrate(fit: DataFrame, now: DataFrame, share: float, keys: list[str]) -> DataFrame:
    """One concentration step: parameters of the closest ``share``, at least, of each group's texts.

    One aggregation of moments by group and bin of distance, of which there are few.
    """
    near = _distance(lookup(fit, now.drop("det"), ["group"], ["doc_id"]))
    binned = near.withColumn("bin", _bin()).groupBy(*keys, "bin").agg(*_moments())
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = binned.withColumns({"before": before, "total": F.sum("n").over(group)}).where(F.col("before") < share * F.col("total"))
    sums = inner.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in binned.columns if c not in (*keys, "bin")])
    return _parameters(sums, keys, consistency(share, _DIMS))


def estimates(fit: DataFrame, work: Workspace, share: float = 0.75, steps: int = 12, trial: int = 2) -> DataFrame:
    """(group, m_i, l_i_j, det): minimum-covariance-determinant estimates of rows (group, doc_id, x0 ... x4).

    Three starts for each group: medians with the interquartile range, medians with the
    range of the middle third, and the plain mean and covariance.  After ``trial`` steps
    from each, that of the least determinant goes on until no group's determinant falls
    by more than a thousandth, or for ``steps``.
    """
    points = [1 / 4, 1 / 3, 1 / 2, 2 / 3, 3 / 4]
    q = fit.groupBy("group").agg(*[F.percentile_approx(f"x{i}", points, 1000).alias(f"q{i}") for i in range(_DIMS)])

    def start(k: int, low: int, high: int, normal: float) -> DataFrame:
        spread = lambda i: F.greatest((F.col(f"q{i}")[high] - F.col(f"q{i}")[low]) / normal, F.lit(FLOORS[i]))
        return q.select("group", F.lit(k).alias("start"), *[F.col(f"q{i}")[2].alias(f"m{i}") for i in range(_DIMS)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i, j in _pairs()], F.lit(0.0).alias("det"))

    plain = _parameters(fit.groupBy("group").agg(*_moments()).withColumn("start", F.lit(2)), ["group", "start"], 1.0)
    now = work.save(start(0, 0, 4, 1.349).unionByName(start(1, 1, 3, 0.8615)).unionByName(plain), "start")
    for k in range(trial):
        now = work.save(_concentrate(fit, now, share, ["group", "start"]), f"trial{k}")
    first = F.row_number().over(Window.partitionBy("group").orderBy("det", "start"))
    now = work.save(now.withColumn("__r", first).where("__r = 1").drop("__r", "start"), "best")
    for k in range(steps):
        then, now = now, work.save(_concentrate(fit, now, share, ["group"]), f"step{k}")
        fell = then.select("group", F.col("det").alias("old")).join(now.select("group", "det"), "group").where(F.col("det") < 0.999 * F.col("old"))
        if fell.isEmpty():
            break
    return now


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.75, steps: int = 12, least: int = 50, cutoff: float = 36.0) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept) for each row.

    kept is false for texts that fail the base rules (fewer than 20 words, or over 30 % of
    the words in repeated 8-word windows) and for those with d2 > ``cutoff`` (for 36, one
    clean normal text in a million).  Estimates are fitted to texts that pass the base
    rules; ``share`` of a group's texts, at least, are in its covariance (subsets end at a
    bin of distance, not at the exact share).  Groups of which fewer than ``least`` texts pass
    the base rules are judged by all texts of their language, and languages of fewer by all
    texts.  Every text has a verdict; d2 is null only where no text passes the
    base rules, and such texts fail.  Null language or source is a group value of its own.
    Ids may be null or repeat.  An empty table gives none.
    """
    work = Workspace(docs.sparkSession, "outliers")
    stats = text_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    stats = work.save(stats.withColumns({f"x{i}": v for i, v in enumerate(_vector())}), "statistics")
    grouped = work.save(_groups(stats, work, least), "grouped")
    fit = grouped.where("not base_failed").select("doc_id", F.explode("fits").alias("group"), *[f"x{i}" for i in range(_DIMS)])
    judged = _distance(lookup(grouped.drop("fits"), estimates(fit, work, share, steps).drop("det"), ["group"], ["doc_id"]))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", kept.alias("kept"))
