"""Exact global ranking, NTILE and interpolated percentiles without a
single-partition window, without sorting whole tables and without a job of
their own: every result is one lazy plan.

``ntile().over(Window.orderBy(...))`` and ``percentile`` over a whole table
move every row (or every distinct value) into one task. A tile or percentile
only depends on the rows at a few ranks. ``rows_at_ranks`` finds those rows in
passes that each end in one row, an uncorrelated scalar subquery of the next:

1. mergeable KLL sketches of each key's order, and exact counts of its rows and
   NULLs. They bracket every wanted rank by two values;
2. on large inputs, exact counts below and inside each bracket and a sketch of
   its inside, which narrow it (or, should a rank lie outside, widen it);
3. exact counts below the brackets, and the rows inside, which are sorted.

Positions, not values, are sketched: value and tie key in one double. So one
value that holds a third of the rows is cut by the tie key like any others, and
what the last pass gathers is bounded by the sketch's error, not by the data.
A bracket that misses its rank raises; it cannot give a wrong row.

* ``ntile_labels`` asks for the first row of each tile, a (value, tie) pair,
  and labels every row where it is by comparing it with at most k - 1 of them.
* ``percentiles`` asks for the values around each percentile.

``global_rank`` numbers the rows of a frame: range-partitioned on the full sort
key plus a unique tie key (one value holding a third of the rows is still
split), sorted and numbered in each partition, checkpointed in the cluster's
shared folder (range bounds come from sampling, so the frame must be evaluated
once), with per-partition counts prefix-summed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkAttributeError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import ensure_checkpoint_dir

RANK = "_rank"
TOTAL = "_total"
VALID = "_valid"


def _sort_keys(order: Sequence[Column], tie: Sequence[str]) -> list[Column]:
    return list(order) + [F.col(t).asc_nulls_first() for t in tie]


def global_rank(df: DataFrame, order: Sequence[Column], tie: Sequence[str],
                rank: str = RANK, total: str = TOTAL,
                count_non_null: str | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (0-based position in the total order ``order, tie``)
    and ``total`` (row count) to every row of ``df``; with
    ``count_non_null`` also ``VALID``, the number of rows where that column
    is not NULL.

    ``tie`` must make the order total (a unique key), otherwise equal rows
    are ranked arbitrarily. ``num_partitions`` sets the range partition
    count (default: the session's shuffle partitions).
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = _sort_keys(order, tie)
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    placed = (ranged
              .sortWithinPartitions(*keys)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    valid = F.count(F.col(count_non_null)) if count_non_null else F.lit(0)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"),
                                        F.min("_pos").alias("_pos0"),
                                        valid.alias("_nv"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = sizes.select(
        "_part", "_pos0",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(everything).alias(total),
        *([F.sum("_nv").over(everything).alias(VALID)] if count_non_null else []))
    # one row per partition: bounded by the shuffle partition count
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(rank, F.col("_offset") + F.col("_pos") - F.col("_pos0"))
            .drop("_part", "_pos", "_pos0", "_offset"))


# ---- rows at given ranks ----------------------------------------------------

# (column, descending): NULLs come first in ascending and last in descending order
Key = tuple[str, bool]
# SQL of a key's number of rows and of NULLs -> SQL of the wanted 0-based ranks
Ranks = Callable[[str, str], Sequence[str]]
SKETCH_K = 4096
GRID = 1024              # quantiles that are read off a sketch
# of the rows, on each side of a rank: four times the sketch's 99 % rank error
MARGIN = 0.005
# above so many bytes in the files read, brackets are narrowed before rows are gathered
NARROW_BYTES = 4 << 30
LOWEST, HIGHEST = "-1.7e308D", "1.7e308D"
# an array constant: the quantile function takes no others
QUANTILES = "cast(split('{}', ',') as array<double>)".format(",".join(str(i / GRID) for i in range(GRID + 1)))


def _input_bytes(df: DataFrame) -> float:
    """What the optimizer knows of the size of the files below ``df``."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    except (AttributeError, PySparkAttributeError):      # Spark Connect: unknown
        return float("inf")
    return sum(float(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _spacing(kind: T.DataType) -> float:
    """Least distance of two values of an exact type; 0 for a float."""
    if isinstance(kind, T.DecimalType):
        return 10.0 ** -kind.scale
    if isinstance(kind, T.IntegralType):
        return 1.0
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return 0.0
    raise TypeError(f"can't rank by {kind.simpleString()}")


def _positions(df: DataFrame, keys: Sequence[Key], tie: str, more: Sequence[str] = ()) -> DataFrame:
    """``_t`` and, for the i-th key, value ``_v{i}``, order value ``_o{i}`` and
    position ``_c{i}``: ascending like (order value, tie), among the NULL rows
    like the tie."""
    t = f"cast(`{tie}` as double)"
    fraction = f"CASE WHEN `{tie}` IS NULL THEN 0D ELSE 0.5D + signum({t}) * log2(1D + abs({t})) / 130D END"
    if not isinstance(df.schema[tie].dataType, T.IntegralType):
        fraction = "0D"
    out = [f"`{tie}` AS _t", *more]
    for i, (column, descending) in enumerate(keys):
        order, step = f"-`{column}`" if descending else f"`{column}`", _spacing(df.schema[column].dataType)
        base = f"cast({order} as double)"
        # the tie moves a position by less than the distance to the next value
        moved = f"CASE WHEN abs({base}) < {step * 2.0 ** 40!r}D THEN {base} + ({fraction}) * {0.99 * step!r}D ELSE {base} END" if step else base
        out += [f"`{column}` AS _v{i}", f"{order} AS _o{i}", f"CASE WHEN `{column}` IS NULL THEN {fraction} ELSE {moved} END AS _c{i}"]
    return df.selectExpr(*out)


def _bracket(quantiles: str, rank: str, n: str) -> tuple[str, str]:
    """SQL of two positions that a rank lies between, but for rare errors of
    the sketch whose GRID + 1 ``quantiles`` these are."""
    low = f"cast(floor(({rank} - {MARGIN!r}D * {n} - 2) * {GRID}D / nullif({n}, 0)) as int)"
    high = f"cast(ceil(({rank} + {MARGIN!r}D * {n} + 2) * {GRID}D / nullif({n}, 0)) as int)"
    return (f"CASE WHEN {low} <= 0 THEN {LOWEST} ELSE get({quantiles}, {low}) END",
            f"CASE WHEN {high} >= {GRID} THEN {HIGHEST} ELSE get({quantiles}, {high}) END")


def _sketched(rows: DataFrame, keys: Sequence[Key], ranks: Sequence[Ranks], extra: Sequence[Column]) -> DataFrame:
    """One row: ``_k{i}``, an array of brackets {known, nulls, rank, low, high}
    for the i-th key's wanted ranks, and the ``extra`` aggregates."""
    sums, quantiles, out = [], [], []
    for i, ((_, descending), wanted) in enumerate(zip(keys, ranks, strict=True)):
        n, valid, nulls = f"_n{i}", f"_m{i}", f"(_n{i} - _m{i})"
        sums += [f"count(1) AS {n}", f"count(_v{i}) AS {valid}",
                 f"kll_sketch_agg_double(_c{i}, {SKETCH_K}) FILTER (WHERE _v{i} IS NOT NULL) AS _s{i}",
                 f"kll_sketch_agg_double(_c{i}, {SKETCH_K}) FILTER (WHERE _v{i} IS NULL) AS _z{i}"]
        quantiles += [f"CASE WHEN {count} > 0 THEN kll_sketch_get_quantile_double({s}{i}, {QUANTILES}) END AS {s}{i}"
                      for s, count in (("_s", valid), ("_z", nulls))]
        in_nulls, inside = (f"r >= {valid}", f"r - IF(r >= {valid}, {valid}, 0)") if descending else \
            (f"r < {nulls}", f"r - IF(r < {nulls}, 0, {nulls})")
        (a, b), (c, d) = _bracket(f"_z{i}", "r.x", nulls), _bracket(f"_s{i}", "r.x", valid)
        # the lambda's x: the rank among the rows of its kind
        out.append(f"""transform(transform(array({", ".join(wanted(n, nulls))}),
            r -> struct(r >= 0 AND r < {n} AS known, {in_nulls} AS nulls, cast({inside} as bigint) AS x)),
            r -> struct(r.known AS known, r.nulls AS nulls, r.x AS rank, IF(r.nulls, {a}, {c}) AS low, IF(r.nulls, {b}, {d}) AS high)) AS _k{i}""")
    one = rows.agg(*map(F.expr, sums), *extra)
    more = one.columns[4 * len(keys):]
    return one.selectExpr("*", *[q.replace(" AS _", " AS _q") for q in quantiles]).selectExpr(
        *[o.replace("_z", "_qz").replace("_s", "_qs") for o in out], *[f"`{c}`" for c in more])


def _inside(b: str, i: int) -> tuple[str, str]:
    """Whether a row of the bracket's kind (NULL or not) stands below it, and
    whether it stands inside."""
    kind = f"{b}.known AND {b}.nulls = (_v{i} IS NULL)"
    return f"{kind} AND _c{i} < {b}.low", f"{kind} AND _c{i} >= {b}.low AND _c{i} <= {b}.high"


def _narrowed(rows: DataFrame, counts: Sequence[int]) -> DataFrame:
    """The brackets of ``rows``' column ``_found``, from a sketch of their
    insides; a rank that lies outside takes the rest of its side."""
    sums, quantiles, out = ["first(_found) AS _found"], [], []
    for i, n in enumerate(counts):
        brackets = []
        for j in range(n):
            b, x = f"_found._k{i}[{j}]", f"{i}_{j}"
            below, inside = _inside(b, i)
            sums += [f"count_if({below}) AS _b{x}", f"count_if({inside}) AS _m{x}",
                     f"kll_sketch_agg_double(_c{i}, {SKETCH_K}) FILTER (WHERE {inside}) AS _s{x}"]
            quantiles.append(f"CASE WHEN _m{x} > 0 THEN kll_sketch_get_quantile_double(_s{x}, {QUANTILES}) END AS _q{x}")
            low, high = _bracket(f"_q{x}", f"({b}.rank - _b{x})", f"_m{x}")
            before, after = f"{b}.rank < _b{x}", f"{b}.rank >= _b{x} + _m{x}"
            brackets.append(f"""named_struct('known', {b}.known, 'nulls', {b}.nulls, 'rank', {b}.rank,
                'low', CASE WHEN {before} THEN {LOWEST} WHEN {after} THEN {b}.high ELSE greatest({low}, {b}.low) END,
                'high', CASE WHEN {before} THEN {b}.low WHEN {after} THEN {HIGHEST} ELSE least({high}, {b}.high) END)""")
        out.append(f"array({', '.join(brackets)}) AS _k{i}")
    return rows.agg(*map(F.expr, sums)).selectExpr("*", *quantiles).selectExpr(*out)


def rows_at_ranks(df: DataFrame, keys: Mapping[str, Key], tie: str, ranks: Mapping[str, Ranks],
                  extra: Sequence[Column] = (), narrow: bool | None = None) -> DataFrame:
    """One row, lazily: for each key an array with the {v, t} (value, tie) of
    the rows at the wanted ranks in the order (value, tie ascending), NULL
    where there is no such rank; ``extra``: further aggregates of ``df``.

    ``tie`` is unique. ``df`` is evaluated once a pass; an exchange in it is
    planned once and read by every pass. The rows of one hot value of a float
    key are gathered for its tie; keys of other types have no such rows."""
    names, pairs, wanted = list(keys), list(keys.values()), [ranks[name] for name in keys]
    counts = [len(w("0", "0")) for w in wanted]
    # the first pass has the columns that ``extra`` aggregates, the others only what ranks need
    found = _sketched(_positions(df, pairs, tie, ["*"] if extra else []), pairs, wanted, extra)
    rows = _positions(df, pairs, tie)
    brackets, more = [f"_k{i}" for i in range(len(pairs))], found.columns[len(pairs):]
    first = found
    if _input_bytes(df) > NARROW_BYTES if narrow is None else narrow:
        found = _narrowed(rows.withColumn("_found", _scalar(found, brackets)), counts)
    sums, out = ["first(_found) AS _found"], []
    for i, n in enumerate(counts):
        tests = [_inside(f"_found._k{i}[{j}]", i) for j in range(n)]
        sums += [f"count_if({below}) AS _b{i}_{j}" for j, (below, _) in enumerate(tests)]
        sums.append(f"collect_list(named_struct('o', _o{i}, 't', _t, 'c', _c{i}, 'v', _v{i})) FILTER (WHERE "
                    + " OR ".join(f"({inside})" for _, inside in tests) + f") AS _r{i}")
        # a NULL row's position and a value's may be alike: each cut looks at rows of its kind
        out.append(f"""transform(zip_with(_found._k{i}, array({", ".join(f"_b{i}_{j}" for j in range(n))}), (b, below) -> struct(b, below)), x ->
            CASE WHEN x.b.known THEN coalesce(
                get(transform(filter(_r{i}, r -> (r.v IS NULL) = x.b.nulls AND r.c >= x.b.low AND r.c <= x.b.high), r -> struct(r.v AS v, r.t AS t)),
                    cast(x.b.rank - x.below as int)),
                raise_error('a sketch\\'s bracket misses its rank')) END) AS `{names[i]}`""")
    one = rows.withColumn("_found", _scalar(found, brackets)).agg(*map(F.expr, sums))
    in_order = [f"sort_array(_r{i}) AS _r{i}" for i in range(len(pairs))]      # by o, then t, NULLs first
    kept = ["_found", *(f"_b{i}_{j}" for i, n in enumerate(counts) for j in range(n))]
    result = one.selectExpr(*kept, *in_order).selectExpr(*out)
    if more:
        result = result.withColumn("_more", _scalar(first, more)).selectExpr(*[f"`{n}`" for n in names], *[f"_more.`{c}` AS `{c}`" for c in more])
    return result


def _scalar(one: DataFrame, columns: Sequence[str]) -> Column:
    """The one row of ``one`` as a scalar subquery: it stands in one column,
    that each row of the next pass points to."""
    return one.selectExpr(f"struct({', '.join(f'`{c}`' for c in columns)}) AS _row").scalar()


def tile_start(tile: int, rows: str, k: int) -> str:
    """SQL of the 0-based rank of the first row of NTILE(k)'s 1-based
    ``tile``; -1 for a tile without rows."""
    return f"IF({tile} <= {rows}, {tile - 1} * ({rows} div {k}) + least({tile - 1}, {rows} % {k}), -1)"


def _from_cut(key: Key, tie: str, cut: str) -> str:
    """Whether a row stands at or after ``cut`` in the order (value, tie)."""
    column, descending = key
    same = f"({cut}.t IS NULL OR coalesce(`{tie}` >= {cut}.t, false))"
    return f"""CASE WHEN {cut} IS NULL THEN false
        WHEN {cut}.v IS NULL THEN IF(`{column}` IS NULL, {same}, {str(not descending).lower()})
        WHEN `{column}` IS NULL THEN {str(descending).lower()}
        ELSE `{column}` {"<" if descending else ">"} {cut}.v OR (`{column}` = {cut}.v AND {same}) END"""


def ntile_labels(df: DataFrame, k: int, keys: Mapping[str, Key], tie: str,
                 tiles: Sequence[int] | None = None, narrow: bool | None = None) -> DataFrame:
    """``df`` plus, for each key, a column with NTILE(k) OVER (ORDER BY value,
    tie), exact. With ``tiles`` only the boundaries where these tiles start
    are looked up, and the label counts the boundaries passed.

    ``tie`` must be unique. Lazy: the cut points are a scalar subquery of the
    frame, whose rows are labelled in place."""
    tiles = list(tiles or range(2, k + 1))
    if not tiles:
        return df.withColumns({out: F.lit(1).cast("bigint") for out in keys})
    cuts = rows_at_ranks(df, keys, tie, {name: lambda n, _: [tile_start(j, n, k) for j in tiles] for name in keys}, narrow=narrow)
    labels = {out: F.expr("cast(1 + " + " + ".join(f"cast({_from_cut(key, tie, f'_cuts.`{out}`[{i}]')} as int)" for i in range(len(tiles)))
                          + " as bigint)") for out, key in keys.items()}
    return df.withColumn("_cuts", _scalar(cuts, list(keys))).withColumns(labels).drop("_cuts")


def percentiles(df: DataFrame, value: str, ps: Mapping[str, float], tie: str,
                extra: Sequence[Column] = (), narrow: bool | None = None) -> DataFrame:
    """One row, lazily: exact continuous percentiles of the non-null values
    (linear interpolation between the values at floor and ceil of
    ``p * (N - 1)``) as doubles, and the ``extra`` aggregates."""

    def around(rows, nulls):
        return [f"IF({rows} > {nulls}, {nulls} + {f}({p!r}D * ({rows} - {nulls} - 1)), -1)" for p in ps.values() for f in ("floor", "ceil")]

    found = rows_at_ranks(df, {"_p": (value, False)}, tie, {"_p": around}, [F.count(value).alias("_valid"), *extra], narrow)
    columns = []
    for i, (name, p) in enumerate(ps.items()):
        at, (low, high) = f"{p!r}D * (_valid - 1)", (f"cast(_p[{2 * i + j}].v as double)" for j in (0, 1))
        columns.append(f"{low} + ({high} - {low}) * ({at} - floor({at})) AS `{name}`")
    return found.selectExpr(*columns, *[f"`{c}`" for c in found.columns[2:]])
