"""Quality rules: robust multivariate outliers per language and source, in DataFrame operations only.

Every text gives counts (words, symbols, repeated lines, words in repeated windows). Texts that pass the base rules give a
vector of transformed statistics; for each (language, source) a minimum-covariance-determinant estimate of centre and
scatter is fitted, and vectors at a large Mahalanobis distance are rejected.

The estimate starts from medians and absolute deviations and, apart from that, from all rows; concentration steps keep
the three quarters of the rows that are nearest and fit again; of the two results the one of smaller determinant counts,
scaled to be consistent for normal data. A step is a histogram of distances and sums of products per group, both
aggregated before they are shuffled, and what holds for all rows is the sum over the groups. A row is there once, with its
distances to both results of its group and of all rows as columns; estimates come to the rows by a broadcast of counted size,
or by salted keys. So no row is shuffled for its group, which may hold any share of them. A group is judged by its own estimate and
the one over all rows mixed: centre and scatter are those of a mixture in which the own estimate weighs
(n - r) / (n - r + `BLEND_ROWS`), n rows in the group and r the most that do not determine four statistics. Every scatter has a floor: differences below `FLOORS` are never far.

Null and empty texts have no words and fail the base rules. Null languages and sources are groups like others; null ids
and repeated rows are rows of their own. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut

#: base rules: least words, and most words in repeated windows, per cent
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
#: log of mean word length, and square roots of the shares of symbols, repeated lines and words in repeated windows
VECTOR = ["x_length", "x_symbols", "x_lines", "x_repeats"]
#: a clean group has no scatter in three of the four; under these floors each statistic can exceed the limit by itself: 7%
#: of symbols, 64% of repeated lines or 28.5% of words in repeated windows, where all else is as in the group's centre
FLOORS = [0.10, 0.05, 0.15, 0.10]
SHARE, STEPS = 0.75, 3
#: three quarters of the rows determine a scatter of four statistics if they are five or more; and the rows beyond `FEW_ROWS`
#: at which a group's own estimate weighs as much as the overall one
FEW_ROWS, BLEND_ROWS = 6, 50
#: most groups whose estimates are broadcast (some 250 bytes each); beyond, keys of the join are split in so many
BROADCAST_GROUPS, SALTS = 50_000, 32
#: chance that a normal vector is rejected
TAIL = 1e-5


def _chi2(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom, by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if z > 0 else 0.0


def _chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < p else (low, mid)
    return low


def _once(value: Column, f) -> Column:
    """f(value) with value computed once, however often f's lambdas look at it."""
    return F.get(F.transform(F.array(value), f), 0)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of consecutive words which the text holds twice or more."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _once(hashed, lambda h: F.when(F.size(h) >= window, F.transform(
        F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(F.slice(h, i + 1, window)))).otherwise(F.array().cast("array<bigint>")))

    def covered(x: Column) -> Column:
        ordered = F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _once(ordered, lambda s: F.filter(F.transform(s, lambda e, j: F.when(
            (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["i"])), lambda i: i.isNotNull()))
        return _once(F.sort_array(twice), lambda at: F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window)))),
            F.lit(0).cast("bigint"), lambda a, n: a + n))

    return _once(windows, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(F.lit(0).cast("bigint")))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, grp (language and source), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.col(lang_col).alias("a"), F.col(source_col).alias("b"))).alias("grp"), text.alias("text"))
    split = docs.select(
        "doc_id", "grp",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("bigint").alias("n_symbols"))
    return split.select(
        "doc_id", "grp", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))


def _vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log(F.col("word_chars") / F.col("n_words")), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def _bin(value: Column) -> Column:
    """Histogram bins that widen with the value: 64 to a doubling of 1 + value."""
    return F.floor(F.log2(value + 1) * 64).cast("int")


def _reached(rows: DataFrame, values: dict[str, Column], share: float, groups: int | None = None) -> DataFrame:
    """For each grp, and for all rows with a null grp, the first bin by which `share` of the rows are reached, by named value.

    Counts of bins are combined before the shuffle; there are some thousands of bins at most. `rows` counts a group's rows.
    """
    first = (F.expr(f"percentile_disc({share}) within group (order by `{name}`)").alias(name) for name in values)
    binned = rows.select("grp", *(_bin(v).alias(name) for name, v in values.items()))
    return _kept(binned.rollup("grp").agg(F.count("*").alias("rows"), *first), groups)


def _kept(table: DataFrame, groups: int | None) -> DataFrame:
    """A table with a few rows to a group, written once, in as many files as the number of groups asks for."""
    return cut(table if groups is None else table.coalesce(1 + groups // 20_000))


def _attached(rows: DataFrame, model: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """rows with the columns of `model`, a table with one row to a group."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(model), "grp", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*VECTOR), F.lit(SALTS)).cast("int"))
    return salted.join(model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "salt"], how).drop("salt")


def _value(bin_: Column) -> Column:
    return F.pow(F.lit(2.0), (bin_ + 0.5) / 64) - 1


def _factored(rows: DataFrame, scatter) -> DataFrame:
    """rows with the Cholesky factor l00, l10, l11, .. of the matrix whose entries scatter(i, j) gives for i >= j."""
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            value = scatter(i, j)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}"))
    return rows


#: columns of an estimate: centre, and factor of the scatter
PARAMETERS = [*(f"m{i}" for i in range(len(VECTOR))), *(f"l{i}{j}" for i in range(len(VECTOR)) for j in range(i + 1))]
#: distances of a row: to its group's estimate by start, and to the one over all rows
KINDS = ["own0", "own1", "all0", "all1"]


def _fitted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and Cholesky factor of the scatter for each key, from sums and sums of products."""
    p = len(VECTOR)
    sums = [F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(VECTOR))]
    sums += [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums)
    factor = SHARE / _chi2(_chi2_quantile(SHARE, p), p + 2)
    out = _factored(out, lambda i, j: F.col(f"c{i}{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0))
    size = F.lit(0.0)
    for i in range(p):
        size = size + F.log(f"l{i}{i}")
    return out.select(*keys, "n", size.alias("log_det"), *PARAMETERS)


def _refitted(rows: DataFrame, chosen: dict[str, Column], groups: int) -> DataFrame:
    """(scope, start, n, log_det, ..) from the rows that each condition, named by KINDS, chooses; sums are combined before the shuffle."""
    each = rows.select("grp", *VECTOR, F.explode(F.array_compact(F.array(*(F.when(which, F.lit(name)) for name, which in chosen.items())))).alias("name"))
    scope = F.when(F.col("name").startswith("all"), "").otherwise(F.col("grp"))
    return _kept(_fitted(each.select(scope.alias("scope"), F.col("name").substr(4, 1).cast("int").alias("start"), *VECTOR), ["scope", "start"]), groups)


def _distances(rows: DataFrame, named: dict[str, object]) -> DataFrame:
    """rows with squared Mahalanobis distances, by forward substitution; for each name a function gives the parameters' columns."""
    made = []
    for i, x in enumerate(VECTOR):
        step = {}
        for name, at in named.items():
            value = F.col(x) - at(f"m{i}")
            for j in range(i):
                value = value - at(f"l{i}{j}") * F.col(f"_{name}{j}")
            step[f"_{name}{i}"] = value / at(f"l{i}{i}")
        rows = rows.withColumns(step)
        made += step
    total = {name: sum((F.col(f"_{name}{i}") * F.col(f"_{name}{i}") for i in range(len(VECTOR))), F.lit(0.0)) for name in named}
    return rows.withColumns(total).drop(*made)


def _distance(rows: DataFrame, name: str) -> DataFrame:
    return _distances(rows, {name: F.col})


def _named(prefix: str):
    return lambda k: F.col(f"{prefix}_{k}")


def _constant(values: dict):
    return lambda k: F.lit(values[k])


def _all_distances(rows: DataFrame, model: DataFrame, groups: int, given: dict[str, str] = {}) -> DataFrame:
    """rows with own0, own1, all0 and all1, their distances to the estimates of either start; `given` names columns that are there."""
    out = rows
    for s in (0, 1):
        own = model.where(f"scope <> '' and start = {s}").select(F.col("scope").alias("grp"), *(F.col(k).alias(f"own{s}_{k}") for k in PARAMETERS))
        out = _attached(out, own, groups)
    overall = {f"all{r['start']}": _constant(r.asDict()) for r in model.where("scope = ''").collect()}
    out = _distances(out, overall | {f"own{s}": _named(f"own{s}") for s in (0, 1)})
    return out.select("grp", *VECTOR, *(F.col(given.get(k, k)).alias(k) for k in KINDS))


def estimates(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """One estimate per grp and one over all rows with scope ''; grp and its number of rows; the number of groups.

    `rows` has grp and VECTOR."""
    shifted = {x: F.lit(2.0) + F.col(x) for x in VECTOR}  # x_length is above -2 + 1, shares are above 0
    middle = _reached(rows, shifted, 0.5)
    groups = middle.count() - 1
    sizes = middle.where("grp is not null").select("grp", "rows")
    if groups <= 0:
        return _fitted(rows.withColumnRenamed("grp", "scope"), ["scope"]), sizes, 0
    every = middle.where("grp is null").first()
    centre = {x: 2.0 ** ((every[x] + 0.5) / 64) - 3 for x in VECTOR}
    mids = middle.where("grp is not null").select("grp", *((_value(F.col(x)) - 2).alias(f"mid_{x}") for x in VECTOR))
    off = _attached(rows, mids, groups)
    away = {f"own_{x}": F.abs(F.col(x) - F.col(f"mid_{x}")) for x in VECTOR} | {f"all_{x}": F.abs(F.col(x) - F.lit(centre[x])) for x in VECTOR}
    spread = _reached(off, away, 0.5, groups)
    mads = spread.where("grp is not null").select("grp", *((_value(F.col(f"own_{x}")) * 1.4826).alias(f"mad_{x}") for x in VECTOR))
    every = spread.where("grp is null").first()
    own, overall = F.lit(0.0), F.lit(0.0)
    for x, floor in zip(VECTOR, FLOORS, strict=True):
        own = own + F.pow(F.col(x) - F.col(f"mid_{x}"), 2) / (F.pow(f"mad_{x}", 2) + floor**2)
        mad = (2.0 ** ((every[f"all_{x}"] + 0.5) / 64) - 1) * 1.4826
        overall = overall + F.pow(F.col(x) - F.lit(centre[x]), 2) / (mad**2 + floor**2)
    # one start from medians, the other from the plain estimate of all rows
    plain = _refitted(rows, {k: F.lit(True) for k in KINDS}, groups)
    near = _attached(off, mads, groups).select("grp", *VECTOR, own.alias("near_own"), overall.alias("near_all"))
    now = _all_distances(near, plain, groups, {"own0": "near_own", "all0": "near_all"})
    for step in range(STEPS):
        limits = _reached(now, {k: F.col(k) for k in KINDS}, SHARE, groups)
        every = limits.where("grp is null").first()
        cuts = limits.where("grp is not null").select("grp", F.col("own0").alias("cut_own0"), F.col("own1").alias("cut_own1"))
        chosen = {k: _bin(F.col(k)) <= (F.col(f"cut_{k}") if k.startswith("own") else F.lit(every[k])) for k in KINDS}
        model = _refitted(_attached(now, cuts, groups), chosen, groups)
        if step < STEPS - 1:
            now = _all_distances(rows, model, groups)
    best = model.groupBy("scope").agg(F.min_by(F.struct("*"), F.struct("log_det", "start")).alias("best"))
    return _kept(best.select("best.*"), groups), sizes, groups


def own_weight(n: Column) -> Column:
    """How much a group of n rows is judged by its own estimate, from 0 to 1."""
    more = F.greatest(n - FEW_ROWS, F.lit(0))
    return more / (more + BLEND_ROWS)


def blended(model: DataFrame, sizes: DataFrame) -> DataFrame:
    """grp, centre and Cholesky factor of each group's estimate mixed with the overall one; sizes has grp and rows."""
    p, names = len(VECTOR), PARAMETERS
    found = model.where("scope = ''").first()
    overall = {f"all_{x}": F.lit(found[x] if found else None).cast("double") for x in names}
    own = model.where("scope <> ''").select(F.col("scope").alias("grp"), *(F.col(x).alias(f"own_{x}") for x in names))
    both = sizes.join(own, "grp").withColumns(overall | {"w": own_weight(F.col("rows"))})

    def product(of: str, i: int, j: int) -> Column:
        return sum((F.col(f"{of}_l{i}{k}") * F.col(f"{of}_l{j}{k}") for k in range(j + 1)), F.lit(0.0))

    def scatter(i: int, j: int) -> Column:
        apart = (F.col(f"own_m{i}") - F.col(f"all_m{i}")) * (F.col(f"own_m{j}") - F.col(f"all_m{j}"))
        return F.col("w") * product("own", i, j) + (1 - F.col("w")) * product("all", i, j) + F.col("w") * (1 - F.col("w")) * apart

    centres = {f"m{i}": F.col("w") * F.col(f"own_m{i}") + (1 - F.col("w")) * F.col(f"all_m{i}") for i in range(p)}
    return _factored(both.withColumns(centres), scatter).select("grp", *names)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null if base_failed) and kept, one row per document."""
    stats = cut(statistics(docs, id_col, text_col, lang_col, source_col).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))))
    rows = stats.where(~F.col("base_failed")).withColumns(dict(zip(VECTOR, _vector(), strict=True)))
    model, sizes, groups = estimates(rows)
    limit = _chi2_quantile(1 - TAIL, len(VECTOR))
    placed = stats.withColumns(dict(zip(VECTOR, (F.when(~F.col("base_failed"), x) for x in _vector()), strict=True)))
    measured = _distance(_attached(placed, _kept(blended(model, sizes), groups), groups, "left"), "distance")
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("distance")).alias("distance"),
        F.when(F.col("base_failed"), False).otherwise(F.col("distance") <= limit).alias("kept"))
