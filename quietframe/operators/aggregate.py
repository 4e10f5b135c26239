"""Queries on DataFrames: truncate, aggregate, align with the keys, add noise once."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..budgets import ApproxDPBudget, Budget
from ..keys import KeySet, KeySetPlan, aligned
from ..plans import nodes as N
from ..plans.analyze import Catalog, Facts, analyze
from ..plans.nodes import Kind
from ..plans.rules import Distance, clean, distance_of, distinct_ids, group_columns, measures, midpoint, split_for_detection
from ..runtime import checkpoint_folder, ship
from ..schema import KEY_TYPES, ColumnDescriptor, ColumnType
from .joins import null_safe_join
from .lower import col, enforce, lower
from .noise import NoiseSpec, add_noise, draw, gap_weights, grid, noisy_prefix, uniform


def settle(df: DataFrame) -> DataFrame:
    """Noise is drawn once: the frame goes to the shared checkpoint folder, and what the
    caller reads are those files, whichever executors are lost later."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def validate(q: N.Query, f: Facts) -> None:
    keys = group_columns(q)
    f.schema.need(keys)
    if isinstance(q.keys, KeySet):
        for c, d in q.keys.schema().items():
            if d.column_type is not f.schema[c].column_type:
                raise ValueError(f"key column {c!r} is {d.column_type.value}, the table's is {f.schema[c].column_type.value}")
    for c in keys:
        if f.schema[c].column_type not in KEY_TYPES:
            raise ValueError(f"column {c!r}: {f.schema[c].column_type.value} can't be a group key")
    if q.name and q.name in keys:
        raise ValueError(f"{q.name!r} is a key column")
    if q.column is not None:
        d = f.schema[q.column]
        if q.column in keys:
            raise ValueError(f"the measure {q.column!r} is a key column")
        if q.column == f.schema.id_column:
            raise ValueError("the ID column can't be a measure")
        if not d.column_type.numeric:
            raise ValueError(f"the measure {q.column!r} must be a number, not {d.column_type.value}")
    if q.low is not None and not q.low < q.high:
        raise ValueError(f"the lower bound {q.low} must be below the upper bound {q.high}")
    if q.quantile is not None and not 0 <= q.quantile <= 1:
        raise ValueError("a quantile is between 0 and 1")
    if q.columns:
        f.schema.need(q.columns)
        if q.kind is Kind.GROUPS and f.schema.id_column in q.columns:
            raise ValueError("the ID column can't be a group")


class Prepared:
    """A query ready to run: rewritten, with its distance and its noise."""

    def __init__(self, q: N.Query, catalog: Catalog, budget: Budget):
        self.catalog, self.budget = catalog, budget
        f = analyze(q.child, catalog)
        if isinstance(q.keys, (list, tuple)) and q.keys:
            f.schema.need(q.keys)
            q = _with_keys(q, KeySet._detect({c: ColumnDescriptor(f.schema[c].column_type, f.schema[c].allow_null) for c in q.keys}))
        validate(q, f)
        q = clean(distinct_ids(q, catalog), catalog)
        self.query, self.facts = q, analyze(q.child, catalog)
        from ..budgets import RhoZCDPBudget

        self.zcdp = isinstance(budget, RhoZCDPBudget)
        self.truncation, self.distance = distance_of(self.facts, group_columns(q), q.kind, self.zcdp)
        self.detect = isinstance(q.keys, KeySetPlan)
        self.own = budget
        if self.detect:
            self.finding, self.own = split_for_detection(budget)
        self.noise = {m.what: m.spec for m in measures(q, self.facts, self.own, self.distance)}

    def noise_info(self) -> list[dict]:
        return [{"what": w, "mechanism": s.kind.value, "parameter": s.parameter} for w, s in self.noise.items()]

    def rows(self) -> DataFrame:
        df = lower(self.query.child, self.catalog)
        for c in self.truncation:
            df = enforce(df, self.facts.schema.id_column, c)
        return df

    def run(self) -> DataFrame:
        q = self.query
        if self.detect:
            names = q.keys.detected()
            g = Prepared(N.Query(q.child, Kind.GROUPS, KeySet.from_dict({}), columns=tuple(names)), self.catalog, self.finding)
            found = g.run()
            if found.isEmpty():
                warnings.warn("no group was found", stacklevel=2)
            keys = q.keys.resolved(KeySet.from_dataframe(found))
            q = _with_keys(q, keys)
        df = ship_and(self.rows())
        out = {Kind.COUNT: _count, Kind.COUNT_DISTINCT: _count, Kind.SUM: _sum, Kind.AVERAGE: _average, Kind.VARIANCE: _spread, Kind.STDEV: _spread, Kind.QUANTILE: _quantile, Kind.BOUNDS: _bounds, Kind.GROUPS: _groups}[q.kind](self, q, df)
        exact = self.budget.is_infinite and q.kind is not Kind.QUANTILE
        out = out if exact else settle(out)
        if q.threshold is not None:
            out = out.where(col(q.name) >= q.threshold)
        return out


def ship_and(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df


def _with_keys(q: N.Query, keys) -> N.Query:
    from dataclasses import replace

    return replace(q, keys=keys)


def _grouped(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*[col(c) for c in keys]).agg(*aggs)


def _count(p: Prepared, q: N.Query, df: DataFrame) -> DataFrame:
    keys = q.keys.columns()
    if q.kind is Kind.COUNT_DISTINCT:
        # distinct rows, as countDistinct() would pass over nulls
        cols = q.columns or tuple(df.columns)
        df = df.select(*[col(c) for c in dict.fromkeys([*keys, *cols])]).distinct()
    out = aligned(q.keys, _grouped(df, keys, F.count(F.lit(1)).alias(q.name)), {q.name: F.lit(0).cast("long")})
    return add_noise(out, {q.name: p.noise["count"]})


def _clamped(q: N.Query, whole: bool) -> Column:
    lit = lambda v: F.lit(int(v)).cast("long") if whole else F.lit(float(v))
    return F.least(F.greatest(col(q.column), lit(q.low)), lit(q.high))


def _total(x: Column, whole: bool, s: NoiseSpec) -> Column:
    """Of longs as a decimal (no overflow, whatever the data); of doubles on the noise's
    grid, where addition is exact and in any order the same."""
    if whole:
        return F.sum(x.cast("decimal(38,0)"))
    if s.none:
        return F.sum(x)
    g = float(grid(s))
    return F.sum(F.round(x / F.lit(g)).cast("decimal(38,0)")).cast("double") * F.lit(g)


def _is_whole(p: Prepared, q: N.Query) -> bool:
    return p.facts.schema[q.column].column_type is ColumnType.INTEGER


def _sum(p: Prepared, q: N.Query, df: DataFrame) -> DataFrame:
    whole, kind = _is_whole(p, q), "long" if _is_whole(p, q) else "double"
    out = _grouped(df, q.keys.columns(), _total(_clamped(q, whole), whole, p.noise["sum"]).cast(kind).alias(q.name))
    return add_noise(aligned(q.keys, out, {q.name: F.lit(0).cast(kind)}), {q.name: p.noise["sum"]})


def _average(p: Prepared, q: N.Query, df: DataFrame) -> DataFrame:
    whole, kind = _is_whole(p, q), "long" if _is_whole(p, q) else "double"
    mid = midpoint(q.low, q.high, whole)
    off = _clamped(q, whole) - F.lit(mid)
    out = _grouped(df, q.keys.columns(), _total(off, whole, p.noise["sum"]).cast(kind).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    out = add_noise(aligned(q.keys, out, {"__sum": F.lit(0).cast(kind), "__n": F.lit(0).cast("long")}), {"__sum": p.noise["sum"], "__n": p.noise["count"]})
    value = F.when(col("__n") > 0, col("__sum") / col("__n") + F.lit(float(mid))).otherwise(F.lit(float(mid)))
    if not p.budget.is_infinite:
        value = F.least(F.greatest(value, F.lit(float(q.low))), F.lit(float(q.high)))
    return out.select(*[col(c) for c in q.keys.columns()], value.cast("double").alias(q.name))


def _spread(p: Prepared, q: N.Query, df: DataFrame) -> DataFrame:
    """Sample variance, at most the square of half the range (0, 1, 1 in [0, 1] has 0.25, not
    1 / 3: golden answers want it at an infinite budget too); NaN for fewer than two rows."""
    whole, most = _is_whole(p, q), ((float(q.high) - float(q.low)) / 2) ** 2
    mid = midpoint(q.low, q.high, whole)
    off = (_clamped(q, whole) - F.lit(mid)).cast("double")
    keys, nan = q.keys.columns(), F.lit(float("nan"))
    if p.own.is_infinite:
        var = F.var_samp(off)
        var = F.when(var.isNotNull(), F.least(var, F.lit(most)))
        return aligned(q.keys, _grouped(df, keys, (var if q.kind is Kind.VARIANCE else F.sqrt(var)).alias(q.name)), {q.name: nan})
    s, sq = p.noise["sum"], p.noise["squares"]
    off = off.cast("long") if whole else off
    kind = "long" if whole else "double"
    out = _grouped(df, keys, _total(off, whole, s).cast(kind).alias("__s"), _total(off * off, whole, sq).cast(kind).alias("__q"), F.count(F.lit(1)).alias("__n"))
    zero = F.lit(0).cast(kind)
    out = add_noise(aligned(q.keys, out, {"__s": zero, "__q": zero, "__n": F.lit(0).cast("long")}), {"__s": s, "__q": sq, "__n": p.noise["count"]})
    sd = lambda c: col(c).cast("double")
    n = F.when(col("__n") > 1, sd("__n"))
    var = F.least(F.lit(most), F.greatest(F.lit(0.0), (sd("__q") - sd("__s") * sd("__s") / n) / (n - 1)))
    value = F.when(col("__n") > 1, var if q.kind is Kind.VARIANCE else F.sqrt(var)).otherwise(nan)
    return out.select(*[col(c) for c in keys], value.alias(q.name))


#: Distinct values that a task ranks at a time, parts that a longer run is cut into, and how often.
RANKED, PARTS, LEVELS = 1 << 18, 4096, 5


def ranked(counts: DataFrame, keys: list[str], low: float) -> DataFrame:
    """The gap to the left of each distinct value: keys, __left, __x, __rank (values below
    it), __after (rank of the next gap) and __total, exactly, from (keys, __x, __n).

    A key's values are cut by value until no part has more than RANKED of them: parts
    are ranked apart, and what stands before a part comes from the table of parts."""
    d, part = counts.withColumn("__c", F.lit(0).cast("long")), [*keys, "__c"]
    for level in range(LEVELS + 1):
        sizes = _grouped(d, part, F.count(F.lit(1)).alias("__m"), F.sum("__n").alias("__here"), F.min("__x").alias("__a"), F.max("__x").alias("__b"))
        if level == LEVELS or (sizes.where("__a < __b").agg(F.max("__m")).first()[0] or 0) <= RANKED:
            break
        at = F.floor((col("__x") - col("__a")) / (col("__b") - col("__a")) * PARTS).cast("long")
        cut = F.when(col("__m") > RANKED, F.coalesce(at, F.lit(0).cast("long"))).otherwise(0)
        d = settle(null_safe_join(d, sizes.drop("__here"), part).select(*[col(c) for c in keys], "__x", "__n", (col("__c") * (PARTS + 1) + cut).alias("__c")))
    run = Window.partitionBy(*[col(c) for c in keys]).orderBy("__c")
    so_far = F.sum("__here").over(run.rowsBetween(Window.unboundedPreceding, 0))
    parts = sizes.select(*[col(c) for c in part], (so_far - col("__here")).alias("__before"), F.lag("__b").over(run).alias("__prev"), F.sum("__here").over(Window.partitionBy(*[col(c) for c in keys])).alias("__total"))
    inside = Window.partitionBy(*[col(c) for c in part]).orderBy("__x")
    after = col("__before") + F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = null_safe_join(d, parts, part)
    left = F.coalesce(F.lag("__x").over(inside), col("__prev"), F.lit(low))
    return joined.select(*[col(c) for c in keys], left.alias("__left"), "__x", (after - col("__n")).alias("__rank"), after.alias("__after"), "__total")


def _quantile(p: Prepared, q: N.Query, df: DataFrame) -> DataFrame:
    """The exponential mechanism over all gaps between a key's distinct values and the
    bounds: each gap's logarithmic weight gets Gumbel noise, the greatest sum wins."""
    keys, low, high = q.keys.columns(), float(q.low), float(q.high)
    x = F.least(F.greatest(col(q.column).cast("double"), F.lit(low)), F.lit(high))
    counts = settle(_grouped(df.withColumn("__x", x), [*keys, "__x"], F.count(F.lit(1)).alias("__n")))
    gaps = ranked(counts, keys, low)
    last = F.when(col("__after") == col("__total"), F.struct(col("__x").alias("__left"), F.lit(high).alias("__right"), col("__after").alias("__rank")))
    both = F.array_compact(F.array(F.struct("__left", col("__x").alias("__right"), "__rank"), last))
    gaps = gaps.select(*[col(c) for c in keys], F.explode(both).alias("__g"), "__total").select(*[col(c) for c in keys], "__g.*", "__total").where("__left < __right")
    eps, share = float(p.noise["quantile"].parameter), float(q.quantile)
    sens, name = float(p.distance.total) * max(share, 1 - share), q.name

    def weigh(frames):
        for f in frames:
            f["__score"], f["__weight"] = gap_weights(f.pop("__rank").to_numpy(float), (f["__right"] - f["__left"]).to_numpy(float), f.pop("__total").to_numpy(float), share, eps, sens)
            yield f

    schema = T.StructType([*[gaps.schema[c] for c in keys], *[T.StructField(c, T.DoubleType()) for c in ("__left", "__right", "__score", "__weight")]])
    best = _grouped(gaps.mapInPandas(weigh, schema), keys, F.max_by(F.struct("__left", "__right"), F.struct("__score", "__weight")).alias("__gap"))
    out = aligned(q.keys, best, {"__gap": F.struct(F.lit(low).alias("__left"), F.lit(high).alias("__right"))})
    out = out.select(*[col(c) for c in keys], "__gap.*")

    def place(frames):
        for f in frames:
            f[name] = f["__left"] + (f.pop("__right") - f["__left"]) * uniform(len(f))
            del f["__left"]
            yield f

    return out.mapInPandas(place, T.StructType([*[out.schema[c] for c in keys], T.StructField(q.name, T.DoubleType())]))


def _bounds(p: Prepared, q: N.Query, df: DataFrame) -> DataFrame:
    """Powers of two: bucket k holds 2 ** (k - 1) < |x| <= 2 ** k, bucket 0 all of at most 1."""
    keys, whole = q.keys.columns(), _is_whole(p, q)
    size = F.abs(col(q.column).cast("decimal(20,0)" if whole else "double")).cast("double")
    bucket = F.when(size <= 1, F.lit(0)).otherwise(F.ceil(F.log2(size))).cast("int")
    counts = _grouped(df.withColumn("__b", bucket), [*keys, "__b"], F.count(F.lit(1)).alias("__n"))
    lists = _grouped(counts, keys, F.map_from_entries(F.collect_list(F.struct("__b", "__n"))).alias("__m"))
    out = aligned(q.keys, lists, {"__m": F.expr("cast(map() as map<int,bigint>)")})
    low, high = q.names
    s = p.noise["bounds"]
    top = 62 if whole else 1023
    kind = T.LongType() if whole else T.DoubleType()

    def run(frames):
        for f in frames:
            ks = [min(noisy_prefix({int(k): int(n) for k, n in (m if isinstance(m, dict) else dict(m)).items()}, s), top) for m in f.pop("__m")]
            f[low] = [-(2**k) if whole else -(2.0**k) for k in ks]
            f[high] = [2**k if whole else 2.0**k for k in ks]
            yield f

    return out.mapInPandas(run, T.StructType([*[out.schema[c] for c in keys], T.StructField(low, kind), T.StructField(high, kind)]))


def threshold(d: Distance, budget: ApproxDPBudget) -> int:
    """Counts of groups that one unit brings in stay below it but with probability delta."""
    e, delta = (float(x) for x in budget.parts)
    total = float(d.total)
    a = math.exp(-e / total)
    return math.ceil(total + (total / e) * max(0.0, math.log(total / (delta * (1 + a)))))


def _groups(p: Prepared, q: N.Query, df: DataFrame) -> DataFrame:
    names = q.columns or tuple(c for c in p.facts.schema.names if c != p.facts.schema.id_column)
    df = df.select(*[col(c) for c in names])
    if p.budget.is_infinite:
        return df.distinct()
    out = add_noise(_grouped(df, list(names), F.count(F.lit(1)).alias("__n")), {"__n": p.noise["groups"]})
    # The noisy counts are settled before they are compared; absent groups have none.
    return settle(out).where(col("__n") >= threshold(p.distance, p.budget)).drop("__n")


def draw_one(s: NoiseSpec) -> float:
    return float(draw(s))
