"""Quality rules: base rules, then robust multivariate outliers per language and source.

Statistics of every whole text are computed in the JVM.  Texts that pass the base rules are described by a
transformed vector (mean word length; square roots of symbols per word, of the share of repeated lines and of the
share of words in repeated windows).  Per language and source, the minimum covariance determinant is sought
by concentration steps from three starts (medians and median deviations; mean and scatter of all; mean and scatter of the half
nearest to the medians): the ``SHARE`` of the group nearest to the centre gives the next centre and scatter, as long as that lowers
the determinant; of the three ends, the one with the smallest determinant is the group's estimate.  Groups that have ended take no
part in further steps.  The estimate is reweighted once (texts within the 0.975 quantile); consistency factors and a floor on the variances make the
final squared Mahalanobis distances comparable with a chi-square law, and documents beyond its
``QUANTILE`` are rejected.

Only DataFrame operations are used.  Quantiles are read from counts on a fixed grid, so they need no sort and
a group that holds a third of all rows meets as one row per grid cell and task.

Edge cases: a null text has no word and fails the base rules; null language and null source form groups of
their own; groups with fewer than ``MIN_GROUP`` passing texts are judged by the estimate of their language, or by
that of the whole table if the language has fewer too (if the table has fewer, they are kept when the base rules pass); repeated rows and ids are judged one by one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.common import SPACES, stage

SYMBOLS = "#*$%&|<>"
SPAN = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SHARE = 0.75
#: A start goes on while a step lowers its determinant (of the logarithm, by at least GAIN); this bound is never met in practice.
MOST_STEPS = 60
GAIN = 1e-3
WEIGHTED = 0.975
QUANTILE = 0.999
MIN_GROUP = 20
#: Standard deviations that are added (squared) to the scatter: differences below them never make an outlier.  Where a
#: group has no spread of its own, each axis rejects alone (the last two from a share of about 0.19).
FLOOR = (0.3, 0.1, 0.1, 0.1)
DIM = len(FLOOR)
GRID = 50  # cells per unit of the logarithm of a distance
FINE = 200  # cells per unit of a statistic


def _stats(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; drops the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # After every white-space character became a blank, the parts between blanks count the white space.
    a = docs.withColumn("_t", text).withColumn("_parts", F.split(F.translate("_t", SPACES, " " * len(SPACES)), " ", -1))
    a = a.withColumn("_words", F.array_remove("_parts", ""))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    a = a.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.length("_t") - F.size("_parts") + 1).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "_lines": lines,
            "_hashes": F.when(
                F.size("_words") >= SPAN,
                F.transform(
                    F.sequence(F.lit(1), F.size("_words") - SPAN + 1), lambda i: F.xxhash64(F.slice("_words", i, SPAN))
                ),
            ),
        }
    ).drop("_parts", "_words", "_t", text_col)
    a = a.withColumns(
        {
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_twice": F.coalesce(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.lit(False)),
        }
    ).drop("_lines")
    placed = F.zip_with("_hashes", F.sequence(F.lit(0), F.size("_hashes") - 1), lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    a = a.withColumn("_placed", F.when(F.col("_twice"), F.sort_array(placed))).drop("_hashes", "_twice")

    def repeated(z: Column, i: Column) -> Column:
        before = (i > 0) & (F.get("_placed", i - 1)["h"] == z["h"])
        after = (i < F.size("_placed") - 1) & (F.get("_placed", i + 1)["h"] == z["h"])
        return F.when(before | after, z["p"])

    a = a.withColumn("_at", F.sort_array(F.array_compact(F.transform("_placed", repeated)))).drop("_placed")
    first = F.struct(F.lit(-2 * SPAN).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "_at", first, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(SPAN))).alias("n"))
    )
    return a.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.col("word_chars") / words,
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi_square_tail(x: float, dim: int = DIM) -> float:
    """P(chi-square > x) for an even number of dimensions."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dim // 2))


def chi_square_quantile(q: float, dim: int = DIM) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi_square_tail(mid, dim) < q else (low, mid)
    return high


def consistency(share: float = SHARE, dim: int = DIM) -> float:
    """Factor that makes the scatter of the nearest ``share`` of a normal sample estimate the full scatter."""
    return share / (1 - chi_square_tail(chi_square_quantile(share, dim), dim + 2))


def _grid_quantile(cells: DataFrame, by: list[str], share: float) -> DataFrame:
    """Smallest cell with at least ``share`` of the rows at or below it; cells: (by..., cell, n)."""
    up = Window.partitionBy(*by).orderBy("cell")
    whole = Window.partitionBy(*by)
    return (
        cells.withColumn("up", F.sum("n").over(up))
        .withColumn("all", F.sum("n").over(whole))
        .where(F.col("up") >= share * F.col("all"))
        .groupBy(*by)
        .agg(F.min("cell").alias("cell"))
    )


def _cholesky(scatter: list[list[Column]]) -> list[list[Column | None]]:
    low: list[list[Column | None]] = [[None] * DIM for _ in range(DIM)]
    for i in range(DIM):
        for j in range(i + 1):
            rest = scatter[i][j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            low[i][j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")
    return low


def _factored(groups: DataFrame) -> DataFrame:
    """Rows (lang, source, m0.., l00..): centre and Cholesky factor of the scatter s00.. of each group."""
    low = _cholesky([[F.col(f"s{max(i, j)}{min(i, j)}") for j in range(DIM)] for i in range(DIM)])
    for i in range(DIM):
        for j in range(i + 1):
            groups = groups.withColumn(f"l{i}{j}", low[i][j])
    return groups


def _distance(rows: DataFrame, groups: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the own group's centre (null without an estimate), and columns of the groups."""
    g = groups.select(
        F.col("lang").alias("gl"), F.col("source").alias("gs"), *extra,
        *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)],
    )
    out = rows.join(g, F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")), "left")
    for i in range(DIM):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIM)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", total).select(*rows.columns, *extra, "d2")


def _moments(rows: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Count, centre and scatter of each group's rows."""
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.avg(f"x{i}").alias(f"m{i}") for i in range(DIM)]
    sums += [F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)]
    got = rows.groupBy(*by).agg(*sums)
    return got.withColumns(
        {f"s{i}{j}": F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i in range(DIM) for j in range(i + 1)}
    )


def _floored(groups: DataFrame, factor: float) -> DataFrame:
    return groups.withColumns(
        {f"s{i}{j}": F.col(f"s{i}{j}") * factor + (FLOOR[i] ** 2 if i == j else 0.0) for i in range(DIM) for j in range(i + 1)}
    )


def _start(rows: DataFrame) -> DataFrame:
    """Centre: medians; scatter: squared median deviations on the diagonal."""
    by = ["lang", "source", "axis"]
    long = rows.select("lang", "source", F.posexplode(F.array(*[f"x{i}" for i in range(DIM)])).alias("axis", "x"))
    cells = long.groupBy(*by, F.floor(F.col("x") * FINE).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    middle = stage(_grid_quantile(cells, by, 0.5).withColumn("m", (F.col("cell") + 0.5) / FINE).drop("cell"), "mcd-median")
    wide = middle.groupBy("lang", "source").pivot("axis", list(range(DIM))).agg(F.first("m"))
    wide = wide.select("lang", "source", *[F.col(str(i)).alias(f"m{i}") for i in range(DIM)])
    near = rows.join(
        wide.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), *[f"m{i}" for i in range(DIM)]),
        F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")),
    ).select("lang", "source", F.posexplode(F.array(*[F.abs(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(DIM)])).alias("axis", "x"))
    cells = near.groupBy(*by, F.floor(F.col("x") * FINE).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    spread = _grid_quantile(cells, by, 0.5).withColumn("d", (F.col("cell") + 0.5) / FINE * 1.4826)
    spread = spread.groupBy("lang", "source").pivot("axis", list(range(DIM))).agg(F.first("d"))
    spread = spread.select(F.col("lang").alias("sl"), F.col("source").alias("ss"), *[F.col(str(i)).alias(f"d{i}") for i in range(DIM)])
    both = wide.join(spread, F.col("lang").eqNullSafe(F.col("sl")) & F.col("source").eqNullSafe(F.col("ss")))
    return both.withColumns(
        {f"s{i}{j}": (F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0.0)) for i in range(DIM) for j in range(i + 1)}
    )


def _nearest(rows: DataFrame, groups: DataFrame, share: float) -> DataFrame:
    """Per start and group: moments of the ``share`` of the rows nearest to the group's centre, and the edge cell."""
    by = ["start", "lang", "source"]
    placed = _distance(rows, groups, ("start",)).where(F.col("start").isNotNull())
    placed = placed.withColumn("cell", F.floor(F.log(F.col("d2") + 1e-6) * GRID))
    cells = placed.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))
    edge = _grid_quantile(cells, by, share).select(*[F.col(c).alias(f"e_{c}") for c in by], F.col("cell").alias("edge"))
    same = (F.col("start") == F.col("e_start")) & F.col("lang").eqNullSafe(F.col("e_lang")) & F.col("source").eqNullSafe(F.col("e_source"))
    chosen = placed.join(edge, same).where("cell <= edge")
    return _moments(chosen, ("start", "lang", "source", "edge"))


def _starts(rows: DataFrame) -> DataFrame:
    """Three starts per group."""
    columns = ["start", "lang", "source", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i in range(DIM) for j in range(i + 1)]]
    middle = stage(_factored(_floored(_start(rows), 1.0)).withColumn("start", F.lit(0)).select(*columns), "mcd-middle")
    whole = _factored(_floored(_moments(rows), 1.0)).withColumn("start", F.lit(1)).select(*columns)
    half = _factored(_floored(_nearest(rows, middle, 0.5), consistency(0.5))).withColumn("start", F.lit(2)).select(*columns)
    return stage(middle.unionByName(whole).unionByName(half), "mcd-starts")


def concentrated(rows: DataFrame) -> DataFrame:
    """Where the concentration steps of each start end: (start, lang, source, edge, n, m.., s.., l.., log_det)."""
    open_, done = _starts(rows), None
    for step in range(MOST_STEPS):
        found = _factored(_floored(_nearest(rows, open_, SHARE), consistency()))
        log_det = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(1, DIM)), 2 * F.log(F.col("l00")))
        found = found.withColumn("log_det", log_det)
        if step:
            # A step that does not lower the determinant is not taken: the start has ended where it stood.
            before = open_.select(*[F.col(c).alias(f"b_{c}") for c in ("start", "lang", "source", "log_det")])
            same = (F.col("start") == F.col("b_start")) & F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source"))
            better = F.col("log_det") < F.col("b_log_det") - GAIN
            found = found.join(before, same).where(better).drop(*before.columns)
        found = stage(found, f"mcd-step{step}")
        if step:
            went = found.select(F.col("start").alias("b_start"), F.col("lang").alias("b_lang"), F.col("source").alias("b_source"))
            same = (F.col("start") == F.col("b_start")) & F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source"))
            ended = open_.join(went, same, "left_anti")
            done = ended if done is None else done.unionByName(ended)
            if found.isEmpty():
                return done
        open_ = found
    return open_ if done is None else done.unionByName(open_)


def estimates(rows: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant centre and scatter of x0.. per (lang, source)."""
    ends = concentrated(rows)
    rest = [c for c in ends.columns if c not in ("lang", "source")]
    # Equal determinants (to nine digits): the first start.
    best = ends.groupBy("lang", "source").agg(F.min_by(F.struct(*rest), F.struct(F.round("log_det", 9), F.col("start"))).alias("g"))
    groups = stage(best.select("lang", "source", "g.*"), "mcd-best")
    inside = _distance(rows, groups).where(F.col("d2") <= chi_square_quantile(WEIGHTED))
    return stage(_factored(_floored(_moments(inside), consistency(WEIGHTED))), "mcd")


def _levels(fit: DataFrame) -> DataFrame:
    """Rows (ll, ls, level): 0 where the group itself has ``MIN_GROUP`` texts, 1 where its language, 2 where the table."""
    by_lang, whole = Window.partitionBy("lang"), Window.partitionBy(F.lit(0))
    n = fit.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumns({"n_lang": F.sum("n").over(by_lang), "n_all": F.sum("n").over(whole)})
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n_lang") >= MIN_GROUP, 1).when(F.col("n_all") >= MIN_GROUP, 2)
    return stage(n.select(F.col("lang").alias("ll"), F.col("source").alias("ls"), level.alias("level")), "quality-levels")


def _names(level: Column) -> dict[str, Column]:
    """Names of the estimate of a level; no name of a language or source can equal a mark."""
    return {
        "lang": F.when(level == 2, F.lit("*")).otherwise(F.concat(F.lit("="), "lang")),
        "source": F.when(level >= 1, F.lit("*")).otherwise(F.concat(F.lit("="), "source")),
    }


def _leveled(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows under the name of the estimate that judges them, with their own names beside."""
    out = rows.withColumns({"own_lang": F.col("lang"), "own_source": F.col("source")}).join(
        levels.where("level is not null"), F.col("lang").eqNullSafe(F.col("ll")) & F.col("source").eqNullSafe(F.col("ls")), "left"
    )
    return out.withColumns(_names(F.coalesce("level", F.lit(0)))).drop("ll", "ls", "level")


def _by_level(fit: DataFrame, levels: DataFrame) -> DataFrame:
    """Texts under the names of all estimates that are needed: their group's, their language's, the table's."""
    need = levels.where("level is not null").select(
        F.when(F.col("level") < 2, F.col("ll")).alias("nl"), F.when(F.col("level") < 1, F.col("ls")).alias("ns"), "level"
    ).distinct()
    same_lang = F.col("lang").eqNullSafe(F.col("nl"))
    on = {0: same_lang & F.col("source").eqNullSafe(F.col("ns")), 1: same_lang}
    parts = [fit.join(need.where(F.col("level") == k), c, "left_semi").withColumns(_names(F.lit(k))) for k, c in on.items()]
    if not need.where("level = 2").isEmpty():
        parts.append(fit.withColumns(_names(F.lit(2))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stage(out, "quality-fit")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept)."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"),
    )
    stats = _stats(rows, "_text").withColumn("base_failed", base_failed())
    stats = stats.withColumns({f"x{i}": c for i, c in enumerate(_vector())})
    stats = stage(stats, "quality-stats")
    fit = stats.where(~F.col("base_failed")).select("lang", "source", *[f"x{i}" for i in range(DIM)])
    levels = _levels(fit)
    groups = estimates(_by_level(fit, levels))
    judged = _distance(_leveled(stats, levels), groups)
    verdict = judged.withColumns({"lang": F.col("own_lang"), "source": F.col("own_source")})
    far = F.coalesce(F.col("d2") > chi_square_quantile(QUANTILE), F.lit(False))
    return verdict.select(
        "id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
