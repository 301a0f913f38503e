"""Group and global aggregates, each shaped so that a hot key is combined map-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiometra.domain import NO_SPECIFIC_TEXT, PLACEHOLDER_TEXTS
from regiometra.functions import coerce_numeric, missing_to_null, round_half_even, trim_all
from regiometra.operators.features import is_member
from regiometra.operators.joins import reindex_to_domain
from regiometra.operators.quantiles import exact_quantiles
from regiometra.operators.scalars import with_scalars


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _number(name: str) -> Column:
    return missing_to_null(_c(name).cast("double"))


def sum_or_zero(value: Column) -> Column:
    """Sum of the present values, 0.0 when there is none."""
    return F.coalesce(F.sum(value), F.lit(0.0))


# A mode is found from (group, value) counts in two steps, so the state of a group is
# one struct per task and never its list of values.

def _most_frequent(count: str, value: str) -> Column:
    """Value with the largest count, the smallest value on ties; a null value never wins."""
    ranked = F.when(_c(value).isNotNull(), F.struct((-_c(count)).alias("n"), _c(value).alias("v")))
    return F.min(ranked).getField("v")


def mode_of(df: DataFrame, column: str, output: str) -> DataFrame:
    """One row: the most frequent present value, the smallest on ties, null if there is none."""
    return (df.groupBy(_c(column)).agg(F.count("*").alias("_n"))
            .agg(_most_frequent("_n", column).alias(output)))


def group_mode(df: DataFrame, group: str, column: str, output: str) -> DataFrame:
    """Mode per group; null groups are dropped, an all-missing group gives null."""
    return (df.filter(_c(group).isNotNull())
            .groupBy(_c(group), _c(column)).agg(F.count("*").alias("_n"))
            .groupBy(_c(group)).agg(_most_frequent("_n", column).alias(output)))


def group_count(df: DataFrame, group: str, column: str, output: str) -> DataFrame:
    """Present values per group."""
    return (df.filter(_c(group).isNotNull()).groupBy(_c(group))
            .agg(F.count(_c(column)).alias(output)))


def group_sum(df: DataFrame, group: str, column: str, output: str) -> DataFrame:
    return (df.filter(_c(group).isNotNull()).groupBy(_c(group))
            .agg(sum_or_zero(_number(column)).alias(output)))


def join_distinct_text(df: DataFrame, key: str, text: str, order: Sequence[str], output: str,
                       separator: str = "; ", default: str | None = NO_SPECIFIC_TEXT) -> DataFrame:
    """Distinct texts per key in order of first appearance, trimmed and joined.

    Distinct comes before trimming, blanks and the placeholder are left out, and a key
    without any text left gets ``default``. Repeats are removed before texts meet, so a
    cell only ever collects what it will hold. A single numeric ``order`` is cheapest: its
    minimum needs no sort, that of several columns does.
    """
    keyed = df.filter(_c(key).isNotNull())
    place = _c(order[0]) if len(order) == 1 else F.struct(*[_c(o) for o in order])
    first = keyed.groupBy(_c(key), _c(text).alias("_text")).agg(F.min(place).alias("_first"))
    trimmed = trim_all(F.col("_text"))
    kept = F.when(~trimmed.isin(PLACEHOLDER_TEXTS),
                  F.struct("_first", "_text", trimmed.alias("_shown")))
    listed = F.transform(F.sort_array(F.collect_list(kept)), lambda item: item["_shown"])
    joined = F.when(F.size(listed) > 0, F.array_join(listed, separator))
    return first.groupBy(_c(key)).agg(F.coalesce(joined, F.lit(default)).alias(output))


def collapse_children(df: DataFrame, key: str, text: str, value: str, target: str,
                      order: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """One row per key: count of texts, sum of values, joined texts, mode of target.

    ``names`` maps count / total / joined / target to output names. Count, sum and mode come
    from one shuffle on (key, target); the texts are joined on by key. Rows are not sorted;
    callers that show the table sort it.
    """
    keyed = df.filter(_c(key).isNotNull())
    figures = (keyed.groupBy(_c(key), _c(target))
               .agg(F.count("*").alias("_rows"), F.count(_c(text)).alias("_texts"),
                    F.sum(_number(value)).alias("_sum"))
               .groupBy(_c(key))
               .agg(F.sum("_texts").alias(names["count"]),
                    sum_or_zero(F.col("_sum")).alias(names["total"]),
                    _most_frequent("_rows", target).alias(names["target"])))
    texts = join_distinct_text(keyed, key, text, order, names["joined"])
    return (figures.join(texts, key)
            .select(_c(key), *[_c(names[n]) for n in ("count", "total", "joined", "target")]))


def describe(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Long table (column_name, count, mean, std, min, q25, q50, q75, max), exact quartiles.

    Columns that are not numeric are skipped, as are absent ones.
    """
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    types = dict(df.dtypes)
    used = [c for c in columns if types.get(c, "").startswith(numeric)]
    if not used:
        raise ValueError("no numeric column to describe")
    plain = []
    for i, c in enumerate(used):
        v = _number(c)
        plain += [F.count(v).alias(f"count_{i}"), F.avg(v).alias(f"mean_{i}"),
                  F.stddev_samp(v).alias(f"std_{i}"), F.min(v).alias(f"min_{i}"),
                  F.max(v).alias(f"max_{i}")]
    wanted = {f"{q}_{i}": (c, p) for i, c in enumerate(used)
              for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
    wide = with_scalars(df.agg(*plain), exact_quantiles(df, wanted))

    def shown(name: str, i: int) -> Column:
        value = _c(f"{name}_{i}").cast("double")
        return (value if digits is None else round_half_even(value, digits)).alias(name)

    stats = ("mean", "std", "min", "q25", "q50", "q75", "max")
    rows = [F.struct(F.lit(c).alias("column_name"), _c(f"count_{i}").alias("count"),
                     *[shown(s, i) for s in stats]) for i, c in enumerate(used)]
    return wide.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column: str, output: str = "JUMLAH") -> DataFrame:
    """Rows per present value, most frequent first, ties by value."""
    return (df.filter(_c(column).isNotNull()).groupBy(_c(column))
            .agg(F.count("*").alias(output)).orderBy(_c(output).desc(), _c(column)))


def _rows(weight: str | None) -> Column:
    """Rows, or where rows are cells of many, the sum of their ``weight``."""
    return F.count("*") if weight is None else F.sum(_c(weight))


def value_share(df: DataFrame, column: str, value_name: str | None = None,
                count_name: str = "JUMLAH", share_name: str = "PERSENTASE", weight: str | None = None) -> DataFrame:
    """``value_counts`` with the percentage of all rows, missing ones included, to 2 decimals.

    Without the column the table is empty. ``weight`` names a column of row counts.
    """
    name = value_name or column
    if column not in df.columns:
        return df.sparkSession.createDataFrame(
            [], f"`{name}` string, `{count_name}` bigint, `{share_name}` double")
    counts = df.groupBy(_c(column).alias(name)).agg(_rows(weight).alias(count_name))
    shares = with_scalars(counts, counts.agg(F.sum(_c(count_name)).alias("_all")))
    share = round_half_even(_c(count_name) / F.col("_all") * 100, 2)
    return (shares.filter(_c(name).isNotNull()).withColumn(share_name, share).drop("_all")
            .orderBy(_c(count_name).desc(), _c(name)))


def value_share_where(df: DataFrame, condition: Column, column: str, **names: str) -> DataFrame:
    """Shares within a subset; an empty subset gives an empty table."""
    return value_share(df.filter(condition), column, **names)


def status_summary(df: DataFrame, column: str, domain: DataFrame,
                   count_name: str = "JUMLAH", share_name: str = "PERSENTASE", weight: str | None = None) -> DataFrame:
    """Count and share of all rows for every status of the domain, in its order.

    An empty input, or one without the column, gives an empty table. ``weight`` names a column of row counts.
    """
    if column not in df.columns:
        return df.sparkSession.createDataFrame(
            [], f"`{column}` string, `{count_name}` bigint, `{share_name}` double")
    counts = df.groupBy(_c(column)).agg(_rows(weight).alias(count_name))
    total = counts.agg(F.sum(_c(count_name)).alias("_all"))
    full = with_scalars(reindex_to_domain(counts, column, count_name, domain), total)
    share = round_half_even(_c(count_name) / F.col("_all") * 100, 2)
    return (full.filter(F.col("_all").isNotNull()).withColumn(share_name, share)
            .select(_c(column), _c(count_name), _c(share_name)))


def group_rate(df: DataFrame, group: str, key: str, flag: Column | None, total_name: str = "total_desa",
               flagged_name: str = "desa_tertinggal",
               rate_name: str = "persentase_tertinggal") -> DataFrame:
    """Units, flagged units and their percentage per group, highest first; empty without the columns."""
    if group not in df.columns or key not in df.columns or flag is None:
        return df.sparkSession.createDataFrame(
            [], f"`{group}` string, `{total_name}` bigint, `{flagged_name}` bigint, `{rate_name}` double")
    return _rates(df, group, F.count(_c(key)), F.count_if(flag), total_name, flagged_name, rate_name)


def _rates(df: DataFrame, group: str, total: Column, flagged: Column, total_name: str = "total_desa",
           flagged_name: str = "desa_tertinggal", rate_name: str = "persentase_tertinggal") -> DataFrame:
    rates = df.filter(_c(group).isNotNull()).groupBy(_c(group)).agg(total.alias(total_name), flagged.alias(flagged_name))
    rate = round_half_even(F.try_divide(_c(flagged_name).cast("double"), _c(total_name)) * 100, 2)
    return rates.withColumn(rate_name, rate).orderBy(_c(rate_name).desc(), _c(group))


def cell_rate(cells: DataFrame, group: str, flag: Column | None) -> DataFrame:
    """``group_rate`` from the cells of ``unit_cells``; empty without the columns."""
    if group not in cells.columns or flag is None:
        return group_rate(cells, group, "_units", None)
    return _rates(cells, group, F.sum("_units"), F.sum(F.when(flag, F.col("_n")).otherwise(0)))


def group_profile_median(df: DataFrame, group: str, medians: Mapping[str, str], status: str,
                         mode_name: str, key: str, count_name: str) -> DataFrame:
    """Per group: exact medians (output -> column), mode of status, count of units."""
    figures = (df.filter(_c(group).isNotNull()).groupBy(_c(group), _c(status))
               .agg(F.count("*").alias("_rows"), F.count(_c(key)).alias("_units"))
               .groupBy(_c(group))
               .agg(_most_frequent("_rows", status).alias(mode_name),
                    F.sum("_units").alias(count_name)))
    middle = exact_quantiles(df, {out: (c, 0.5) for out, c in medians.items()}, [group])
    return (figures.join(middle, group, "left")
            .select(_c(group), *[_c(m) for m in medians], _c(mode_name), _c(count_name)))


def group_profile_mean(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return (df.filter(_c(group).isNotNull()).groupBy(_c(group))
            .agg(*[F.avg(_number(c)).alias(c) for c in columns]))


def cluster_summary(df: DataFrame, label: str, cluster: str, columns: Sequence[str],
                    status: str) -> DataFrame:
    """Means of the available measures and mode of status, by label if present, else by id.

    Means are carried as sums and counts through the (group, status) step of the mode, so
    both come out of one shuffle of the input.
    """
    if cluster not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{cluster}` int")
    group = label if label in df.columns else cluster
    used = [c for c in columns if c in df.columns]
    partial = [agg for i, c in enumerate(used) for agg in
               (F.sum(_number(c)).alias(f"_sum_{i}"), F.count(_number(c)).alias(f"_n_{i}"))]
    means = [F.try_divide(F.sum(f"_sum_{i}"), F.sum(f"_n_{i}")).alias(c)
             for i, c in enumerate(used)]
    return (df.filter(_c(group).isNotNull()).groupBy(_c(group), _c(status))
            .agg(F.count("*").alias("_rows"), *partial)
            .groupBy(_c(group)).agg(*means, _most_frequent("_rows", status).alias(status)))


def crosstab_row_percent(df: DataFrame, rows: str, columns: str,
                         values: Sequence[str]) -> DataFrame:
    """Counts as percentages of all rows with a present value; one column per value of the domain, sorted.

    Values outside the domain have no column but count in the whole.
    """
    names = sorted(values)
    counts = (df.filter(_c(rows).isNotNull() & _c(columns).isNotNull()).groupBy(_c(rows))
              .agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(_c(columns) == n).alias(f"_{i}") for i, n in enumerate(names)]))
    return counts.select(_c(rows), *[(F.col(f"_{i}") / F.col("_all") * 100).alias(n) for i, n in enumerate(names)])


_NARROW, _GRAM_BLOCK = 24, 64
_SUMS = ("n", "si", "sj", "sii", "sjj", "sij")


def wide_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``correlation_matrix`` for many columns: a task adds up matrix products of column blocks, pair by pair of blocks.

    With absent values as zeros and a mask of the present ones, products of values, squares and masks give every sum of
    every pairwise complete pair. A task sends one record per pair of columns, which are summed by key. A column
    counts as constant where its variance is below rounding. A task holds about 50 bytes per pair of columns.
    """
    d = len(columns)
    numbers = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(columns)])
    center = [m or 0.0 for m in numbers.agg(*[F.avg(f"x{i}") for i in range(d)]).first()]  # one number per column
    blocks = [range(a, min(a + _GRAM_BLOCK, d)) for a in range(0, d, _GRAM_BLOCK)]

    def products(batches):
        import numpy as np
        import pyarrow as pa

        held = {(a, b): 0.0 for a in range(len(blocks)) for b in range(a, len(blocks))}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - center
            mask = ~np.isnan(x)
            x, m = np.where(mask, x, 0.0), mask.astype(float)
            square = x * x
            for a, b in held:
                i, j = slice(blocks[a][0], blocks[a][-1] + 1), slice(blocks[b][0], blocks[b][-1] + 1)
                held[a, b] = held[a, b] + np.stack([m[:, i].T @ m[:, j], x[:, i].T @ m[:, j], m[:, i].T @ x[:, j],
                                                    square[:, i].T @ m[:, j], m[:, i].T @ square[:, j], x[:, i].T @ x[:, j]])
        for (a, b), sums in held.items():
            if np.ndim(sums):
                i, j = (g.ravel().astype(np.int32) for g in np.meshgrid(blocks[a], blocks[b], indexing="ij"))
                own = i <= j
                yield pa.RecordBatch.from_arrays([pa.array(i[own]), pa.array(j[own]), *[pa.array(s.ravel()[own]) for s in sums]],
                                                 names=["i", "j", *_SUMS])

    sent = numbers.mapInArrow(products, "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS))
    cells = sent.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS]).where("n > 0")
    spread = [F.col(f"s{k}{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n") for k in "ij"]
    varies = [v > F.lit(1e-12) * F.col(f"s{k}{k}") for v, k in zip(spread, "ij")]
    r = (F.col("sij") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(spread[0] * spread[1])
    r = F.when(varies[0] & varies[1], F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
    cells = cells.select("i", "j", r.alias("r"))
    both = cells.unionByName(cells.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    names = F.array(*[F.lit(c) for c in columns])
    rows = df.sparkSession.range(d).select(F.col("id").cast("int").alias("i"))  # a column without a pair has a row too
    return (rows.join(both, "i", "left").groupBy("i")
            .agg(*[F.max(F.when(F.col("j") == j, F.col("r"))).alias(c) for j, c in enumerate(columns)])
            .orderBy("i").select(F.get(names, F.col("i")).alias("feature"), *[_c(c) for c in columns]))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix over pairwise complete rows, one row per column of the matrix.

    Absent columns are skipped, fewer than two give an empty table, a constant column null.

    Values are centred by the column means, so plain sums of products lose no digits, and they
    are summed per pattern of missing columns: within a pattern every pair has the same rows, so
    one sum per column and one per pair suffice. A pair then adds up the patterns it is in.
    More than 24 columns go by ``wide_correlations``.
    """
    used = [c for c in columns if c in df.columns]
    d = len(used)
    if d < 2:
        return df.sparkSession.createDataFrame([], "feature string")
    if d > _NARROW:
        return wide_correlations(df, used)
    numbers = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(used)])
    means = numbers.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)])
    centred = with_scalars(numbers, means).select(
        *[(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"x{i}") for i in range(d)])
    pattern = "concat(" + ", ".join(f"if(x{i} IS NULL, '0', '1')" for i in range(d)) + ")"
    sums = centred.groupBy(F.expr(pattern).alias("pattern")).agg(F.count("*").alias("n"), *[
        F.expr(f"{f}(x{i}) AS {f}_{i}") for i in range(d) for f in ("sum", "min", "max")], *[
        F.expr(f"sum(x{i} * x{j}) AS p_{i}_{j}") for i in range(d) for j in range(i, d)])

    entries = ", ".join(
        f"struct({i} AS i, {j} AS j, n, sum_{i} AS si, sum_{j} AS sj, p_{i}_{i} AS sii, "
        f"p_{j}_{j} AS sjj, p_{min(i, j)}_{max(i, j)} AS sij, min_{i} AS lo_i, max_{i} AS hi_i, "
        f"min_{j} AS lo_j, max_{j} AS hi_j)" for i in range(d) for j in range(d))
    totals = [F.expr(f"{f}({c}) FILTER (WHERE sij IS NOT NULL) AS {c}") for f, c in (
        *(("sum", c) for c in ("n", "si", "sj", "sii", "sjj", "sij")),
        *((f, f"{e}_{k}") for f, e in (("min", "lo"), ("max", "hi")) for k in "ij"))]
    cells = sums.selectExpr(f"inline(array({entries}))").groupBy("i", "j").agg(*totals)
    shared = "(sij - si * sj / n) / nullif("
    shared += "sqrt(greatest(sii - si * si / n, 0D) * greatest(sjj - sj * sj / n, 0D)), 0D)"
    r = F.expr(f"CASE WHEN lo_i < hi_i AND lo_j < hi_j "
               f"THEN if(i = j, 1.0D, greatest(-1.0D, least(1.0D, {shared}))) END")
    name = F.get(F.array(*[F.lit(c) for c in used]), F.col("i"))
    return (cells.withColumn("r", r).groupBy("i")
            .agg(*[F.expr(f"max(r) FILTER (WHERE j = {j})").alias(c) for j, c in enumerate(used)])
            .orderBy("i").select(name.alias("feature"), *[_c(c) for c in used]))


def kpis(df: DataFrame, region: str, status: str, score: str, lagging: Sequence[str],
         top_status: str) -> DataFrame:
    """One row: units, regions, share lagging, share at the top, mean score; zeros when empty.

    Units are first combined per (region, status), which bounds what the distinct count sees.
    """
    def has(c: str) -> bool:
        return c in df.columns

    keys = [c for c in (region, status) if has(c)]
    return cell_kpis(unit_cells(df, keys, None, score), region, status, lagging, top_status)


def unit_cells(df: DataFrame, keys: Sequence[str], unit: str | None, score: str) -> DataFrame:
    """One row per combination of ``keys``: rows ``_n``, present units, sum and number of present scores."""
    value = _number(score) if score in df.columns else F.lit(None).cast("double")
    units = F.count(_c(unit)) if unit and unit in df.columns else F.lit(None).cast("bigint")
    return df.groupBy(*[_c(c) for c in keys]).agg(
        F.count("*").alias("_n"), units.alias("_units"), F.sum(value).alias("_sum"), F.count(value).alias("_scored"))


def cell_kpis(cells: DataFrame, region: str, status: str, lagging: Sequence[str], top_status: str) -> DataFrame:
    """``kpis`` from the cells of ``unit_cells``."""
    def has(c: str) -> bool:
        return c in cells.columns

    def share(flag: Column) -> Column:
        part = F.sum(F.when(flag, F.col("_n")).otherwise(0)).cast("double")
        return F.coalesce(F.try_divide(part, F.sum("_n")) * 100, F.lit(0.0))

    zero = F.lit(0.0)
    return cells.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_units"),
        (F.count_distinct(_c(region)) if has(region) else F.lit(0).cast("bigint"))
        .alias("total_regions"),
        (share(is_member(status, lagging)) if has(status) else zero).alias("pct_lagging"),
        (share(is_member(status, [top_status])) if has(status) else zero).alias("pct_top"),
        F.coalesce(F.try_divide(F.sum("_sum"), F.sum("_scored")), zero).alias("mean_score"))


def cluster_kpis(df: DataFrame, cluster: str) -> DataFrame:
    """One row: clustered rows and distinct clusters; zeros without the cluster column."""
    if cluster not in df.columns:
        return df.sparkSession.createDataFrame([(0, 0)], "clustered_rows bigint, n_clusters bigint")
    return (df.groupBy(_c(cluster)).agg(F.count("*").alias("_n"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("clustered_rows"),
                 F.count(_c(cluster)).alias("n_clusters")))


def percentile_rank(df: DataFrame, points: Mapping[str, float]) -> DataFrame:
    """One row: per column, % of all rows strictly below its point, 1 decimal; 0.0 when empty."""
    aggs = []
    for c, point in points.items():
        if c not in df.columns:
            aggs.append(F.lit(0.0).alias(c))
            continue
        below = F.avg(F.coalesce(_number(c) < F.lit(float(point)), F.lit(False)).cast("double"))
        aggs.append(F.coalesce(round_half_even(below * 100, 1), F.lit(0.0)).alias(c))
    return df.agg(F.count("*").alias("_n"), *aggs).drop("_n")


def default_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: median of the coerced values, 0.0 where absent or all missing."""
    types = dict(df.dtypes)
    present = [c for c in columns if c in types]
    absent = {c: F.lit(0.0) for c in columns if c not in types}
    if not present:
        return df.sparkSession.range(1).select(*[v.alias(c) for c, v in absent.items()])
    typed = df.select(*[(coerce_numeric(_c(c)) if types[c] == "string" else _number(c)).alias(c)
                        for c in present])
    found = exact_quantiles(typed, {c: (c, 0.5) for c in present})
    return found.select(*[absent[c].alias(c) if c in absent
                          else F.coalesce(_c(c), F.lit(0.0)).alias(c) for c in columns])


def outlier_rate(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Long table (flag, n_flagged, pct_flagged) from one pass."""
    row = df.agg(F.count("*").alias("_all"),
                 *[F.count_if(_c(f)).alias(f"_n_{i}") for i, f in enumerate(flags)])
    lines = [F.struct(F.lit(f).alias("flag"), F.col(f"_n_{i}").alias("n_flagged"),
                      (F.try_divide(F.col(f"_n_{i}").cast("double"), F.col("_all")) * 100)
                      .alias("pct_flagged")) for i, f in enumerate(flags)]
    return row.select(F.inline(F.array(*lines)))
