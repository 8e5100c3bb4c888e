"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target exceeds its size is taken whole as often as fits (complete epochs); the rest of the target is a
weighted sample without replacement: every document draws an exponential key, divided by its quality weight (a column,
or else one that falls with the share of symbols), and the documents of a source are taken in order of the key until their sizes reach the rest.

The order is never sorted in one task. Keys are cut into bands; sizes are summed by source and band, and prefix sums
over the bands tell which bands are taken whole and which band the budget ends in. That band is cut again, and only
what is then in the last band of a source is sorted.

Targets: sources weigh 5, 2, 1 and so on in the order of their names (by code point, null last). Their shares of all
words stop at a bound of epochs; what is over goes to the others by weight until none is above. With sources in order
of bound over weight this is one prefix sum.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own; keys are drawn
from id and text, so only rows equal in both draw the same key, and they count one by one; a null weight is 1, one of 0
or less is drawn last; a document of size 0 belongs to the complete epochs only. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Bands that keys are cut into, twice.
BANDS = 256
SEED = 7
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    parts = F.split(text, SPACE, -1)
    edges = (F.get(parts, 0) == "").cast("int") + F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - edges).cast("long")


def quality(text: Column) -> Column:
    """Weight in (0, 1]: texts with many symbols among their characters are drawn later."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    share = symbols / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4 * share), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for rows ``source, source_size``, one for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("bound"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    # Words for each unit of weight if this source and all behind it share what the bounded ones before it leave.
    rate = (F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_rate = F.min(F.when(F.col("bound") / F.col("weight") >= F.col("rate"), F.struct("place", "rate"))).over(every)["rate"]
    ranked = weighed.withColumn("rate", rate).withColumn("place", F.row_number().over(order))
    settled = ranked.withColumn("open", open_rate)
    target = F.when(F.col("open").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("weight") * F.col("open")))
    return settled.select("source", "source_size", target.cast("double").alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cut(rows: DataFrame, band: Column) -> tuple[DataFrame, DataFrame]:
    """Split ``rows(source, size, rest, ...)`` by where the budget ``rest`` of a source ends among its bands.

    First: rows of bands that are taken whole. Second: rows of the band the budget ends in, ``rest`` less what the
    bands before it hold. Rows of later bands are in neither.
    """
    banded = rows.withColumn("band", band)
    sums = banded.groupBy("source", "band").agg(F.sum("size").alias("own"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("band")
    run = sums.select(F.col("source").alias("s"), F.col("band").alias("b"), "own", (F.sum("own").over(order) - F.col("own")).alias("ahead"), F.col("rest").alias("budget"))
    placed = banded.join(run, _same("source", "s") & (F.col("band") == F.col("b")))
    whole = placed.where("ahead + own <= budget").select(*rows.columns)
    edge = placed.where("ahead < budget and ahead + own > budget").withColumn("rest", F.col("rest") - F.col("ahead")).select(*rows.columns)
    return whole, edge


def key(id: Column, text: Column, weight: Column, seed: int = SEED) -> Column:
    """Exponential draw of a row over its weight; small keys are taken first."""
    drawn = F.xxhash64(F.lit(seed), F.coalesce(id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    share = (F.shiftrightunsigned(drawn, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(share) / F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(1e-9))


def _times(facts: DataFrame, weights: tuple[float, ...], max_epochs: int, bands: int) -> DataFrame:
    """``facts(row, id, source, size, key)`` with ``source_size``, ``target`` and ``times``, how often a row is taken."""
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialize(targets(sizes, weights, max_epochs).withColumn("epochs", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("int")))
    goal = goal.select(F.col("source").alias("name"), "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    placed = facts.join(goal, _same("source", "name")).drop("name")
    # 1 - exp(-key) spreads the keys of full weight evenly over [0, 1).
    spread = (F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(float(bands))
    open_rows = placed.where("size > 0 and rest > 0").select("row", "id", "source", "size", "key", "rest")
    whole, edge = _cut(open_rows, F.floor(spread))
    more, last = _cut(edge, F.floor((spread - F.floor(spread)) * F.lit(float(bands))))
    order = Window.partitionBy("source").orderBy("key", F.col("id").cast("string"), "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    # The document that the budget ends in is taken if more than half of it fits.
    ends = last.withColumn("through", F.sum("size").over(order)).where(F.col("through") - F.col("size") / 2 <= F.col("rest")).select("row")
    extra = whole.select("row").union(more.select("row")).union(ends).withColumn("again", F.lit(1))
    return placed.join(extra, "row", "left").withColumn("times", F.col("epochs") + F.coalesce("again", F.lit(0)))


def _facts(row: Column, id: Column, source: Column, text: Column, weight: Column | None, seed: int) -> list[Column]:
    size = words(text)
    return [row.alias("row"), id.alias("id"), source.cast("string").alias("source"), size.alias("size"), key(id, text, quality(text) if weight is None else weight, seed).alias("key")]


def mixed(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weight_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """One row for each document: the id, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted)."""
    weight = None if weight_col is None else F.col(weight_col)
    facts = materialize(docs.select(*_facts(F.monotonically_increasing_id(), F.col(id_col), F.col(source_col), F.col(text_col), weight, seed)))
    done = _times(facts, weights, max_epochs, bands)
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def repeated(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weight_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns as they were.

    Rows are numbered and written once, so that those that share an id, or have none, are told apart. Documents without
    a word come once.
    """
    held = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    of = F.col("doc").getField
    facts = materialize(held.select(*_facts(F.col("row"), of(id_col), of(source_col), of(text_col), None if weight_col is None else of(weight_col), seed)))
    times = _times(facts, weights, max_epochs, bands).select("row", F.when(F.col("size") > 0, F.col("times")).otherwise(1).alias("times")).where("times > 0")
    many = held.join(times, "row").select("doc", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    return many.select("doc.*")
