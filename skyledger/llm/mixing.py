"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Among all document rates that meet each source's token target, the rates closest in relative entropy to 1 are
exponential in the document's size: rate = min(3, exp(t * size / mean size)) with one multiplier t per source.
The multipliers solve the convex dual. Newton's steps run on a histogram (source, size, documents), to which
the corpus folds first; a bracket around t guards each step. One small row per source is kept between steps.

Rates become copies without loss: whole parts are taken as they are; the words still missing go to the
documents whose fraction beats a number hashed from the id, in order of the excess, each once more, and the
last of them in part. The running sum behind this works in blocks of that order, so a source with a third of
all rows is spread over many tasks. So a source takes its target to the word. A document never exceeds three
copies. Reruns agree: the multiplier is rounded to six decimals, every later sum is over whole numbers.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null id is ordered first.
A document of size 0 takes nothing. Repeated rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BLOCKS = 2048
STEPS = 200  # a bracket of 1e-8 takes some 45 halvings


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, limited to `cap` times the size.

    Resharing the excess by weight until no target is above its limit fills all unlimited sources to one level
    per weight. Sources in order of limit per weight: the limited ones are a prefix. One row per source, in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("fill", F.col("source").asc_nulls_last())
    upto = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    rows = rows.withColumn("fill", F.col("limit") / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every).getField("level")
    return rows.select("source", "source_size", F.least("limit", F.col("weight") * final).alias("target"))


def _rate(t: Column, x: Column) -> Column:
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(t * x, F.lit(50.0))))


def dual(histogram: DataFrame, targets: DataFrame, steps: int = STEPS, tolerance: float = 1e-10) -> DataFrame:
    """(source, source_size, target, t): Newton's iterations on all sources at once.

    Per step one aggregate over the histogram gives each source its taken words f(t) and the derivative. A step
    that leaves the bracket [lo, hi] is replaced by the bracket's middle. A source at three times its size has
    no finite solution; its t stays null and its rate is the limit. A source is done when its words meet the target
    or its bracket is far narrower than the digits kept of t; more than `steps` steps are an error.
    """
    open_ = (F.col("source_size") > 0) & (F.col("target") < MAX_COPIES * F.col("source_size"))
    mean = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    start = F.log(F.col("target") / F.col("source_size"))
    state = targets.join(mean, targets.source.eqNullSafe(mean.source)).select(
        targets.source, "source_size", "target", "mean", F.when(open_, start).alias("t"),
        F.lit(-1e4).alias("lo"), F.when(open_, F.log(F.lit(float(MAX_COPIES))) * F.col("mean") / F.col("least") + 1e-6).alias("hi"), (~open_).alias("done"))
    state = materialize(state, "dual")
    for _ in range(steps):
        h, s = histogram.alias("h"), state.alias("s")
        joined = h.join(s.filter("NOT done"), F.expr("h.source <=> s.source"))
        x = F.col("h.size") / F.col("s.mean")
        r = _rate(F.col("s.t"), x)
        words = F.col("h.size") * F.col("h.n")
        sums = joined.groupBy(F.col("h.source").alias("source")).agg(
            F.sum(words * r).alias("f"), F.sum(F.when(r < MAX_COPIES, words * r * x).otherwise(0.0)).alias("slope"))
        u = sums.alias("u")
        gap = F.col("u.f") - F.col("s.target")
        lo = F.when(gap < 0, F.col("s.t")).otherwise(F.col("s.lo"))
        hi = F.when(gap > 0, F.col("s.t")).otherwise(F.col("s.hi"))
        step = F.col("s.t") - gap / F.col("u.slope")
        moved = s.join(u, F.expr("s.source <=> u.source"), "left").select(
            "s.source", "s.source_size", "s.target", "s.mean", "s.t", lo.alias("lo"), hi.alias("hi"), step.alias("step"),
            (F.col("s.done") | (F.abs(gap) <= tolerance * F.col("s.target")) | F.coalesce(hi - lo <= 1e-8, F.lit(False))).alias("done"))
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        state = materialize(moved.select("source", "source_size", "target", "mean",
                                         F.when(F.col("done"), F.col("t")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("t"), "lo", "hi", "done"), "dual")
        if state.filter("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"the dual has not converged in {steps} steps")
    return state.select("source", "source_size", "target", "mean", F.round("t", 6).alias("t"))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))


def solved(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, mean, t), one stored row per source, from (doc_id, source, size)."""
    histogram = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = materialize(source_targets(totals, weights), "targets")
    multipliers = dual(histogram.filter("size > 0"), targets)
    sources = targets.alias("a").join(multipliers.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.source", "a.source_size", "a.target", "b.mean", "b.t")
    return materialize(sources, "sources")


def _rounded(doc_id: Column, size: Column, mean: Column, t: Column) -> tuple[Column, Column, Column]:
    """(whole, excess, room): copies taken as they are, place in the order for one more, words that it would add."""
    rate = F.when(size > 0, F.when(t.isNull(), F.lit(float(MAX_COPIES))).otherwise(_rate(t, size / mean))).otherwise(0.0)
    whole = F.floor(rate)
    uniform = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return whole, uniform - (rate - whole), F.when(whole < MAX_COPIES, size).otherwise(0)


def _shared(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, excess, more): `more` words are taken beside the whole copies."""
    d, s = slim.alias("d"), sources.alias("s")
    whole, excess, room = _rounded(F.col("d.doc_id"), F.col("d.size"), F.col("s.mean"), F.col("s.t"))
    rated = d.join(s, F.expr("d.source <=> s.source")).select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", whole.alias("whole"), excess.alias("excess"), room.alias("room"))
    rated = rated.withColumn("block", F.floor((F.col("excess") + 1) * (BLOCKS // 2)).cast("int"))

    blocks = rated.groupBy("source", "block").agg(F.sum("room").alias("room"), F.sum(F.col("whole") * F.col("size")).alias("taken"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("room").over(before), F.lit(0)).alias("offset"), F.sum("taken").over(Window.partitionBy("source")).alias("sure"))
    order = Window.partitionBy("source", "block").orderBy("excess", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rated.withColumn("upto", F.sum("room").over(order))
    r, b = running.alias("r"), blocks.alias("b")
    short = F.round(F.col("r.target")).cast("long") - F.col("b.sure") - (F.col("b.offset") + F.col("r.upto") - F.col("r.room"))
    more = F.greatest(F.lit(0), F.least(F.col("r.room"), short))
    return r.join(b, F.expr("r.source <=> b.source AND r.block = b.block")).select("r.doc_id", "r.source", "r.size", "r.source_size", "r.target", "r.whole", "r.excess", more.alias("more"))


def mix(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) from (doc_id, source, size)."""
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("long")
    return _shared(slim, solved(slim, weights)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def cutoffs(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, mean, t, last): the mix as one stored row per source.

    `last` is the last document in a source's order that is taken once more, with the words it adds: those before
    it are taken once more as a whole, those after it are not.
    """
    sources = solved(slim, weights)
    last = _shared(slim, sources).filter("more > 0").groupBy("source").agg(F.max(F.struct("excess", "doc_id", "size", "more")).alias("last"))
    return materialize(sources.alias("a").join(last.alias("b"), F.expr("a.source <=> b.source"), "left").select("a.source", "a.mean", "a.t", "b.last"), "cutoffs")


def with_copies(docs: DataFrame, cuts: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", out: str = "copies") -> DataFrame:
    """Add the number of copies of each document: its taken words by its size, a part counting from a half on.

    Only the small table of `cutoffs` meets the documents, so their texts stay where they are.
    """
    small = cuts.select(F.struct("source", "mean", "t", "last").alias("__cut"))
    rows = docs.withColumn("__size", n_words(F.col(text_col))).join(small, F.col(source_col).eqNullSafe(F.col("__cut.source")))
    size, last = F.col("__size"), F.col("__cut.last")
    whole, excess, room = _rounded(F.col(id_col), size, F.col("__cut.mean"), F.col("__cut.t"))
    place, end = F.struct(excess, F.col(id_col), size), F.struct(last["excess"], last["doc_id"], last["size"])
    more = F.when(last.isNull(), 0).when(F.col(id_col).eqNullSafe(last["doc_id"]) & (size == last["size"]), last["more"]).when(place < end, room).otherwise(0)
    taken = F.when(size > 0, F.floor((whole * size + more) / size + 0.5)).otherwise(0)
    return rows.withColumn(out, taken.cast("int")).drop("__size", "__cut")


def balance(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Taken words of every document so that each source meets its target."""
    return mix(sized(docs, id_col, source_col, text_col))
