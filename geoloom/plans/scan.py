"""Ordered scans that never hold a whole group in one task.

A plain window over (file) or (path) puts every row of a hot key into one task. Here each
group is cut into chunks along its order. Values inside a chunk come from a window over
(keys, chunk); what crosses a chunk border comes from one small row per chunk, scanned in
a second window and joined back on (keys, chunk). The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65536


def chunk_of(order: Column | str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of an integer order column: unique values give at most ``rows`` per chunk."""
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(rows))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | str,
    *,
    running: dict[str, Column] | None = None,
    fill: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    index: str | None = None,
) -> DataFrame:
    """Add ordered columns per key group.

    running: inclusive running sums. fill: last non-null value up to the row. lag and lead:
    value of the neighbouring row, null at the ends. index: 1-based row number. Rows without a
    key or chunk are left out. ``chunk``
    must not decrease along ``order``. Given as the name of a column, it is kept, so a second
    scan over the same chunks finds the rows already partitioned.
    """
    kept_chunk = isinstance(chunk, str)
    ck = chunk if kept_chunk else "__chunk"
    running, fill, lag, lead = dict(running or {}), dict(fill or {}), dict(lag or {}), dict(lead or {})
    if index:
        running[index] = F.lit(1).cast("bigint")
    fed = {**running, **fill, **lag, **lead}
    feed = {name: f"__in_{name}" for name in fed}
    inputs = {feed[n]: c for n, c in fed.items()}
    base = df.withColumns(inputs if kept_chunk else {ck: chunk, **inputs})
    # rows without a key or place are in no group; said here, it holds for both branches below
    for name in (*keys, ck):
        base = base.filter(F.col(name).isNotNull())

    inside = Window.partitionBy(*keys, ck).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = {"__first": F.row_number().over(inside) == 1, "__end": F.lead(F.lit(1)).over(inside).isNull()}
    totals, carry = {}, {}
    before = Window.partitionBy(*keys).orderBy(ck)
    ahead = before.rowsBetween(Window.unboundedPreceding, -1)
    for name in running:
        local[f"__loc_{name}"] = F.sum(feed[name]).over(upto)
        totals[name] = F.col(f"__loc_{name}")
        carry[name] = F.sum(f"__tot_{name}").over(ahead)
    for name in fill:
        local[f"__loc_{name}"] = F.last(feed[name], ignorenulls=True).over(upto)
        totals[name] = F.col(f"__loc_{name}")
        carry[name] = F.last(f"__tot_{name}", ignorenulls=True).over(ahead)
    for name in lag:
        local[f"__loc_{name}"] = F.lag(feed[name]).over(inside)
        totals[name] = F.col(feed[name])
        carry[name] = F.lag(f"__tot_{name}").over(before)
    for name in lead:
        local[f"__loc_{name}"] = F.lead(feed[name]).over(inside)
        local[f"__head_{name}"] = F.first(feed[name]).over(upto)
        totals[name] = F.col(f"__head_{name}")
        carry[name] = F.lead(f"__tot_{name}").over(before)

    # What crosses a border is read off the last row of each chunk, from the rows that the windows saw.
    # The test on all columns holds always; with it both branches need the same columns, so they share
    # one shuffle and the input is read once.
    windowed = base.withColumns(local).filter(F.hash(*base.columns) >= -(1 << 31))
    carried = (
        windowed.filter("__end").select(*keys, ck, *[c.alias(f"__tot_{n}") for n, c in totals.items()])
        .select(*keys, ck, *[c.alias(f"__car_{n}") for n, c in carry.items()])
    )
    joined = windowed.join(carried, [*keys, ck])
    result = {}
    for name in running:
        result[name] = F.col(f"__loc_{name}") + F.coalesce(F.col(f"__car_{name}"), F.lit(0))
    for name in fill:
        result[name] = F.coalesce(F.col(f"__loc_{name}"), F.col(f"__car_{name}"))
    for name in lag:
        result[name] = F.when(F.col("__first"), F.col(f"__car_{name}")).otherwise(F.col(f"__loc_{name}"))
    for name in lead:
        result[name] = F.when(F.col("__end"), F.col(f"__car_{name}")).otherwise(F.col(f"__loc_{name}"))
    kept = [c for c in df.columns if c not in result]
    return joined.select(*kept, *[c.alias(n) for n, c in result.items()])


def written_scan(
    df: DataFrame, keys: list[str], order: list[str], place: Column, *, lead: dict[str, Column] | None = None, index: str | None = None
) -> DataFrame:
    """An ordered scan over a written table whose groups are usually small.

    The largest group is counted first. While it fits one chunk, a plain window is a bounded one;
    otherwise each group is cut along ``place``, a position from 0 to 1 that grows with ``order``.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= CHUNK_ROWS:
        w = Window.partitionBy(*keys).orderBy(*order)
        added = {name: F.lead(c).over(w) for name, c in (lead or {}).items()}
        if index:
            added[index] = F.row_number().over(w).cast("bigint")
        return df.withColumns(added)
    parts = -(-largest // CHUNK_ROWS) * 4
    return ordered_scan(df, keys, order, F.floor(place * parts), lead=lead, index=index)


def chunked_fold(
    df: DataFrame,
    keys: list[str],
    order: str,
    item: Column,
    start,
    step,
    *,
    rows: int = 4096,
):
    """Left fold with data-dependent state along each group, in bounded chunks.

    ``item`` is the struct fed to the fold, ``start(first item)`` the state at the head of a
    group and ``step(state, item, previous item)`` the next state (the previous item is null at
    the head of a group); the state must carry ``out``, an array that ``step`` extends and that is
    emptied at every chunk border.

    All chunks fold at once, each as if a group started at its head. Rounds then compare the exit
    state of each chunk with the entry of the next. Of chunks that entered wrongly, the first of a
    run takes its neighbour's exit and the rest of the run takes the same state, as if it passed
    through. The first one is right after that, so a group needs at most as many rounds as it has
    chunks; a state that passes through unchanged, as along a straight path, needs two however
    long the path, and chunks whose fold forgets its entry settle at once. A round folds and writes
    only the chunks whose entry moved; the items are written once.

    Returns one row per (keys, chunk) with ``out`` and ``exit`` (the state without ``out``).
    """
    from geoloom.plans.scratch import discard, growing, materialize

    at = [*keys, "__chunk"]
    numbered = df.withColumns({"__chunk": chunk_of(order, rows), "__item": item})
    packed = (
        numbered.groupBy(*at)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__item").alias("v")))).alias("__a"))
        .withColumn("__items", F.transform("__a", lambda s: s["v"]))
        .drop("__a")
    )
    packed = materialize(packed, "fold")
    along = Window.partitionBy(*keys).orderBy("__chunk")
    borders = packed.select(*at, F.lag(F.element_at("__items", -1)).over(along).alias("__before"))
    packed = growing(packed).join(materialize(borders, "borders"), at)

    def folded(frame: DataFrame, number: int) -> DataFrame:
        before = F.concat(F.array("__before"), F.slice("__items", 1, F.size("__items") - 1))
        pairs = F.zip_with("__items", before, lambda v, p: F.struct(v.alias("v"), p.alias("p")))
        done = F.aggregate(pairs, F.col("__entry"), lambda s, x: step(s, x["v"], x["p"]))
        rows = frame.withColumn("__done", done)
        rows = rows.select(
            *at, F.col("__entry").dropFields("out").alias("__entry"), F.col("__done").dropFields("out").alias("exit"),
            F.col("__done")["out"].alias("out"), F.lit(number).alias("__round"),
        )
        return materialize(rows, "fold")

    fresh = packed.withColumn("__entry", start(F.col("__items")[0]))
    rounds = [folded(fresh, 0)]
    light = rounds[0].select(*at, "__entry", "exit")
    blank = fresh.schema["__entry"].dataType["out"].dataType
    while True:
        handed = light.withColumn("__handed", F.lag("exit").over(along))
        moved = F.col("__handed").isNotNull() & ~F.col("__handed").eqNullSafe(F.col("__entry"))
        handed = handed.withColumn("__moved", moved)
        heads = F.when(F.col("__moved") & ~F.coalesce(F.lag("__moved").over(along), F.lit(False)), F.col("__handed"))
        given = F.last(heads, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
        update = handed.withColumn("__given", given).filter("__moved").select(*at, "__given")
        update = materialize(update, "moved")
        if update.isEmpty():
            break
        entry = F.col("__given").withField("out", F.array().cast(blank))
        rounds.append(folded(packed.join(update, at).withColumn("__entry", entry), len(rounds)))
        new = rounds[-1].select(*at, F.col("__entry").alias("__e"), F.col("exit").alias("__x"), F.lit(True).alias("__new"))
        both = growing(light).join(new, at, "left")
        renewed = materialize(
            both.select(
                *at, F.when(F.col("__new"), F.col("__e")).otherwise(F.col("__entry")).alias("__entry"),
                F.when(F.col("__new"), F.col("__x")).otherwise(F.col("exit")).alias("exit"),
            ), "light",
        )
        discard(light)
        light = renewed
    if len(rounds) == 1:
        return rounds[0].select(*at, "out", "exit")
    every = rounds[0]
    for part in rounds[1:]:
        every = every.unionByName(part)
    last = every.groupBy(*at).agg(F.max_by(F.struct("out", "exit"), "__round").alias("__last"))
    return last.select(*at, "__last.out", "__last.exit")
