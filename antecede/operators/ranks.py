"""Exact ranks and quantile cuts that never sort a whole group in one task."""

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Keys of the sample that slices of a table are cut by, and so the most slices there are.
SLOTS = 4096
#: Rows that a slice holds on average, as far as the sample allows, and the least number of slices.
SLICE_ROWS, LEAST_SLICES = 1 << 16, 16


def rank_within(
    df: DataFrame, group: list[str], order: list, bucket: Column, name: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based ``row_number`` over ``group`` in ``order``, in two levels.

    ``bucket`` must grow with ``order``. Rows are numbered inside (group, bucket), and the
    rows in earlier buckets of the group, a count per bucket, are added. A group that holds
    most of the table is then spread over its buckets. ``total`` names a column for the rows of the group.

    Without a ``group`` the buckets must be those of ``range_buckets``, whose number is bounded: their
    sums are one array, looked up in place, so that no rows meet in one task and nothing is joined.
    """
    keys = [*group, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = bucketed.withColumn("_inside", inside)
    if not group:
        return _shifted(numbered, counts, df.columns, name, total)
    earlier = (
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(*group)).alias("_total"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return numbered.join(offsets, same).select(
        *df.columns,
        (F.col("_offset") + F.col("_inside")).alias(name),
        *([F.col("_total").alias(total)] if total else []),
    )


def _shifted(
    numbered: DataFrame, counts: DataFrame, columns: list[str], name: str, total: str | None
) -> DataFrame:
    """Places inside buckets plus the rows before them, from an array of running sums by bucket."""
    listed = F.transform(F.sequence(F.lit(0), F.lit(SLOTS)), lambda b: F.coalesce(F.col("_by")[b], F.lit(0).cast("bigint")))
    by = F.map_from_entries(F.collect_list(F.struct(F.col("_bucket").cast("int"), "_rows"))).alias("_by")
    ends = F.aggregate(
        listed,
        F.array(F.lit(0).cast("bigint")),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    sums = counts.agg(by).select(ends.alias("ends")).scalar()
    placed = numbered.withColumn("_ends", sums)
    offset = F.get("_ends", F.col("_bucket").cast("int"))
    return placed.select(
        *columns,
        (offset + F.col("_inside")).alias(name),
        *([F.element_at("_ends", -1).alias(total)] if total else []),
    )


def ntile_cuts(
    df: DataFrame, group: str, order: list[str], bucket: Column, k: int
) -> DataFrame:
    """The order key at which each of the tiles 1..k-1 of a group starts, as one array per group.

    Tile sizes differ by at most one, the larger tiles first. Only the buckets in which a
    tile starts are sorted; all other rows are merely counted. The result has one row per group.
    """
    keys = df.select(group, *order, bucket.alias("_bucket"))
    sizes = keys.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns(
        {
            "_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            "_total": F.sum("_rows").over(whole),
        }
    )
    tile = F.col("_tile")
    small, larger = F.floor(F.col("_total") / k), F.col("_total") % k
    holding = (
        sizes.withColumn("_tile", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
        .withColumn("_start", tile * small + F.least(tile.cast("bigint"), larger) - F.col("_offset"))
        .filter((F.col("_start") >= 0) & (F.col("_start") < F.col("_rows")))
        .groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_holding"))
        .agg(F.collect_list("_start").alias("_starts"))
    )
    same = [F.col(group).eqNullSafe(F.col("_group")), F.col("_bucket") == F.col("_holding")]
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    return (
        keys.join(holding, same)
        .withColumn("_inside", inside.cast("bigint") - 1)
        .filter(F.array_contains("_starts", F.col("_inside")))
        .groupBy("_group")
        .agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_cuts"))
    )


def apply_cuts(df: DataFrame, cuts: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """0-based tile of every row: the number of cuts at or below its key.

    There is one row of cuts per group, and groups are few. They are broadcast, so no row is moved: shuffled by
    group, all rows would go to as many tasks as there are groups.
    """
    key = F.struct(*order)
    tile = F.size(F.filter("_cuts", lambda c: c <= key))
    return (
        df.join(F.broadcast(cuts), F.col(group).eqNullSafe(F.col("_group")), "left")
        .select(*df.columns, F.greatest(tile, F.lit(0)).alias(name))
    )


def range_buckets(df: DataFrame, order: str) -> DataFrame:
    """Adds ``_range``, which slice of the table a key of any type is in: 0 to ``SLOTS``.

    One pass over the keys draws a sample that tasks can combine: each of ``SLOTS`` slots of the key
    hash keeps the key with the lowest hash and the number of its rows. The rows tell how
    many slices there are, one for each ``SLICE_ROWS`` as far as the sample goes, and evenly spaced keys
    of the sample are their edges. A row's slice is found in two steps of about
    the root of that number of comparisons. Edges only shift the sizes of slices: slices grow with
    the key, so ranks built on them are exact. Equal keys share a slice, null keys the first.
    """
    key = F.col(order)
    hashed = F.xxhash64(key)
    kept = df.filter(key.isNotNull()).groupBy(F.pmod(hashed, F.lit(SLOTS)).alias("_slot"))
    kept = kept.agg(F.min_by(key, hashed).alias("_key"), F.count(F.lit(1)).alias("_rows"))
    sample = kept.agg(F.array_sort(F.collect_list("_key")).alias("_keys"), F.sum("_rows").alias("_rows"))
    slices = F.greatest(F.ceil(F.col("_rows") / SLICE_ROWS), F.lit(LEAST_SLICES))
    every = F.greatest(F.ceil(F.size("_keys") / slices), F.lit(1)).cast("int")
    spaced = sample.withColumn("_every", every).withColumn(
        "_edges", F.filter("_keys", lambda k, i: (i + 1) % F.col("_every") == 0)
    )
    # Every n-th edge by itself, to be looked at first.
    step = F.greatest(F.ceil(F.sqrt(F.size("_edges"))), F.lit(1)).cast("int")
    spaced = spaced.withColumn("_step", step)
    wide = F.filter("_edges", lambda k, i: (i + 1) % F.col("_step") == 0)
    found = spaced.select(F.struct(F.col("_edges").alias("edges"), F.col("_step").alias("step"), wide.alias("wide")).alias("s"))
    edged = df.withColumn("_cut", found.scalar())

    def at_or_below(edges: Column) -> Column:
        return F.coalesce(F.size(F.filter(edges, lambda e: e <= key)), F.lit(0))

    first = F.coalesce(F.col("_first") * F.col("_cut")["step"], F.lit(0))
    following = F.slice(F.col("_cut")["edges"], first + 1, F.greatest(F.col("_cut")["step"] - 1, F.lit(0)))
    return edged.withColumn("_first", at_or_below(F.col("_cut")["wide"])).select(
        *df.columns, (first + at_or_below(following)).alias("_range")
    )
