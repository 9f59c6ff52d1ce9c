"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a token target.  Among all document rates r (0 to ``cap`` times) that meet the targets, the ones
closest to 1 in relative entropy are r = min(cap, exp(lambda * x)) with x the document's size over its source's scale.
The multipliers solve a convex dual, one dimension per source, by safeguarded Newton steps: a step is one aggregation
over the (source, size) counts.  Rates are rounded to whole copies by a hash of the id, and what rounding missed is
made up with a few documents per size class, largest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import drop_staged, staged

WEIGHTS = (1, 2, 3)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 25
TOLERANCE = 1e-5  # of a source's target, for the Newton steps
REPAIR_PASSES = 4
REPAIR_TOLERANCE = 2e-4  # of a source's target, for the copies

_KEY = ["_none", "_src"]


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``size``: the words of the whole text; a null text has none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def _keyed(df: DataFrame, source_col: str) -> DataFrame:
    """Join keys of a source: a null source is a source of its own."""
    return df.withColumns({"_none": F.col(source_col).isNull(), "_src": F.coalesce(F.col(source_col), F.lit(""))})


def source_targets(sized: DataFrame, source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(_none, _src, source_size, target): weights repeat along the sources by code point, null last.

    A target stops at ``cap`` times its source's size and the excess goes to the others by weight.  With sources in the
    order of cap over weight those that stop are a prefix, so one pass of running sums finds them.  The windows run over
    one row per source.
    """
    return _targets(_keyed(sized, source_col), weights, cap)


def _targets(keyed: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    per = keyed.groupBy(*_KEY).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("_none", "_src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("most", F.col("source_size") * float(cap))
    rising = W.orderBy(F.col("most") / F.col("w"), "_none", "_src").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("_none", "_src")
    per = per.withColumns({
        "all_size": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything),
        "most_before": F.coalesce(F.sum("most").over(rising), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(rising), F.lit(0.0)),
    })
    per = per.withColumn("stops", F.col("most") * (F.col("all_w") - F.col("w_before"))
                         < F.col("w") * (F.col("all_size") - F.col("most_before")))
    stopped = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(0.0)).over(everything)
    level = F.try_divide(F.col("all_size") - stopped("most"), F.col("all_w") - stopped("w"))
    return (per.withColumn("level", level)
            .select(*_KEY, "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target")))


def _rate(cap: float) -> Column:
    """Rate of a document from its source's multiplier; sources at their cap take every document ``cap`` times."""
    return (F.when(F.col("full"), F.lit(float(cap)))
            .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("scale"))))))


def multipliers(keyed: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(_none, _src, source_size, target, full, scale, lam): the dual solution, one row per source.

    Newton steps start at rate 1 and stay inside a bracket that every step narrows; a step outside of it is replaced by
    bisection (or doubling while the bracket is open).
    """
    counts = staged(keyed.filter(F.col("size") > 0).groupBy(*_KEY, "size").agg(F.count("*").alias("n")), "sizes")
    # The scale makes the first Newton step target / size - 1.
    scale = counts.groupBy(*_KEY).agg((F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = (targets.join(scale, _KEY, "left")
             .withColumns({"full": F.col("target") >= F.col("source_size") * float(cap) * (1 - 1e-12), "scale": F.coalesce("scale", F.lit(1.0)),
                           "lam": F.lit(0.0), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "miss": F.lit(float("inf"))}))
    state = staged(state, "dual")
    for _ in range(NEWTON_STEPS):
        rate = _rate(cap)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = (counts.join(state.filter(~F.col("full")), _KEY)
                .groupBy(*_KEY).agg(F.sum(words).alias("words"), F.sum(slope).alias("slope")))
        step = state.join(sums, _KEY, "left")
        gap = F.coalesce(F.col("words") - F.col("target"), F.lit(0.0))
        step = step.withColumns({"gap": gap, "miss": F.when(F.col("target") > 0, F.abs(gap) / F.col("target")).otherwise(0.0)})
        step = step.withColumns({"hi": F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi")),
                                 "lo": F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo"))})
        newton = F.col("lam") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        closed = (F.col("lo") > float("-inf")) & (F.col("hi") < float("inf"))
        other = (F.when(closed, (F.col("lo") + F.col("hi")) / 2)
                 .when(F.col("gap") > 0, F.col("lam") * 2 - 1).otherwise(F.col("lam") * 2 + 1))
        moved = F.when(F.col("miss") <= TOLERANCE, F.col("lam")).otherwise(F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(other))
        nxt = staged(step.withColumn("lam", moved).drop("words", "slope", "gap"), "dual")
        drop_staged(state)
        state = nxt
        if state.agg(F.coalesce(F.max("miss"), F.lit(0.0))).first()[0] <= TOLERANCE:
            break
    drop_staged(counts)
    return state.drop("lo", "hi", "miss")


def mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
        cap: int = CAP) -> DataFrame:
    """Add source_size, target, rate, copies and taken (copies * size) to every row of ``with_sizes``' result.

    Repeated rows count as documents of their own, a null source is a source, empty texts keep one copy and take no
    words.  The copies depend on ids, sizes and sources alone, so reruns agree.
    """
    made = ["source_size", "target", "rate", "copies", "taken"]
    kept = [c for c in sized.columns if c not in made]
    # The caller's columns travel as one, so that none of them can meet a working column's name.
    whole = F.struct(*[F.col(c) for c in kept]).alias("_whole")
    keyed = sized.select(whole, F.col(source_col).alias("_of"), F.col(id_col).alias("_id"), "size")
    rows = staged(_keyed(keyed, "_of").select(*_KEY, "size", F.xxhash64(F.lit(29), "_id").alias("_tie"),
                                              F.xxhash64(F.lit(17), "_id", "size", *_KEY).alias("_draw"), "_whole")
                  .withColumn("_row", F.monotonically_increasing_id()), "mix")
    targets = staged(_targets(rows, weights, cap), "targets")
    dual = _per_source(multipliers(rows, targets, cap))
    draw = F.pmod("_draw", F.lit(1 << 52)) / float(1 << 52)

    def drawn(df: DataFrame) -> DataFrame:
        rated = df.join(dual, _KEY).withColumn("rate", _rate(cap))
        return rated.withColumn("copies", F.least(F.lit(cap), F.floor(F.col("rate") + draw)).cast("int"))

    copies = staged(drawn(rows.select("_row", *_KEY, "size", "_tie", "_draw")).select("_row", *_KEY, "size", "copies", "_tie"), "copies")
    changes = None  # some dozens of documents per source and pass
    for _ in range(REPAIR_PASSES):
        change = _per_source(staged(_repairs(copies, targets, cap), "repair"))
        if change.isEmpty():
            break
        changes = change if changes is None else changes.unionByName(change)
        fixed = staged(_repaired(copies, change), "copies")
        drop_staged(copies)
        copies = fixed
    drop_staged(copies)
    # The rows stay where they are: rates and draws are the same again, and the repairs are few.
    whole = drawn(rows)
    if changes is not None:
        whole = _repaired(whole, _per_source(staged(changes.groupBy("_row").agg(F.sum("_by").alias("_by")), "repairs")))
    return whole.withColumn("taken", F.col("copies") * F.col("size")).select("_whole.*", *made)


def _repaired(df: DataFrame, change: DataFrame) -> DataFrame:
    return (df.join(change, "_row", "left").withColumn("copies", (F.col("copies") + F.coalesce("_by", F.lit(0))).cast("int")).drop("_by"))


# Sources whose rows are broadcast to the documents; more of them are joined with a shuffle.
BROADCAST_SOURCES = 100_000


def _per_source(table: DataFrame) -> DataFrame:
    """A staged table of one row per source, broadcast if it is small: documents of a hot source then stay where they are."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def _repairs(copies: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(_row, _by): documents that take one copy more or less, so that each source comes closer to its target.

    Per source and power of two of the size at most four documents are offered (an aggregate, whatever the source's
    rows); per source the offers, some dozens, are walked through from the largest and taken while they fit the error.
    """
    taken = copies.groupBy(*_KEY).agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    error = (targets.join(taken, _KEY).withColumn("error", F.col("target") - F.col("taken"))
             .filter(F.abs("error") > REPAIR_TOLERANCE * F.col("target")).select(*_KEY, "error"))
    error = _per_source(staged(error, "error"))
    open_rows = (copies.filter(F.col("size") > 0).join(error, _KEY)
                 .filter((F.col("size") <= F.abs("error")) & F.when(F.col("error") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)))
    row = F.struct("size", "_tie", "_row")
    # Ids of equal hash and size are copies of one document, so the row number never changes which sizes are taken.
    offers = (open_rows.groupBy(*_KEY, "error", F.floor(F.log2("size")).alias("class"))
              .agg(F.array(F.max(row), F.min(row), F.max_by(row, F.struct("_tie", "_row")), F.min_by(row, F.struct("_tie", "_row"))).alias("some"))
              .groupBy(*_KEY, "error").agg(F.reverse(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some"))))).alias("some")))
    start = F.struct(F.abs("error").alias("left"), F.array().cast("array<bigint>").alias("rows"))

    def walk(state, offer):
        fits = offer["size"] <= state["left"]
        return F.struct(F.when(fits, state["left"] - offer["size"]).otherwise(state["left"]).alias("left"),
                        F.when(fits, F.concat(state["rows"], F.array(offer["_row"]))).otherwise(state["rows"]).alias("rows"))

    picked = offers.select("error", F.aggregate("some", start, walk)["rows"].alias("rows"))
    return picked.select(F.explode("rows").alias("_row"), F.signum("error").cast("int").alias("_by"))


def replicate(mixed: DataFrame) -> DataFrame:
    """One row per copy; documents without copies go."""
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.filter(F.col("copies") > 0).withColumn("_copy", copies).drop("_copy")
