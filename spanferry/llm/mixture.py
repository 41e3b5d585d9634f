"""Mixing sources to target weights without sorting documents.

Each document has a fixed pseudo-random place: a 60-bit hash of its key. A source's budget is met by taking every
document below a threshold of that place, so a smaller budget always takes a subset of a larger one. Thresholds are
found in histograms: words are summed by source and bucket, the bucket in which the budget is crossed is the only
one split further, and the last step filters by the threshold. No document is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanferry.operators.joins import lookup
from spanferry.operators.ordering import positions
from spanferry.shared import settle

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
PLACE_DIGITS = 15  # hexadecimal digits of a place: 60 bits
STEP_DIGITS = 3  # digits refined by one histogram: 4096 buckets a source


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def place(*keys: Column) -> Column:
    """The document's place: the first 60 bits of an MD5 of its keys, as hexadecimal digits."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.substring(F.md5(F.encode(F.concat_ws("\n", *parts), "utf-8")), 1, PLACE_DIGITS)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Per source of ``sizes(source, source_size)``: its weight and target.

    Sources in code-point order, null last, take ``weights`` in turn and split ``share`` times all words by weight. A
    target stops at ``most`` times its source's size; what is cut off is split again by weight over the rest, until no
    target is above. Only sums reach the driver. Needs ``share <= most``. Sources without words have target 0.
    """
    if share > most:
        raise ValueError("the sources cannot hold that share")
    keyed = sizes.select(F.col("source").isNull().alias("_last"), "source", "source_size")
    turn = F.expr(f"array({', '.join(str(int(w)) for w in weights)})[pmod(_rank - 1, {len(weights)})]")
    ranked = settle(positions(keyed, ["_last", "source"], name="_rank").withColumn("weight", turn.cast("long")))
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level_over, level_under, capped_before = 0.0, 1, -1
    cap = F.col("source_size") * F.lit(float(most))
    while True:
        above = F.col("weight") * F.lit(float(level_over)) / F.lit(level_under) > cap if capped_before >= 0 else F.lit(False)
        got = ranked.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.sum(F.when(above, F.col("source_size"))).alias("words"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
        ).first()
        if got["n"] == capped_before:
            break
        capped_before = got["n"]
        level_over, level_under = budget - most * (got["words"] or 0), got["weight"] or 1
    target = F.least(F.col("weight") * F.lit(float(level_over)) / F.lit(level_under), cap)
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per ``_source``: every place below ``_cut`` is taken, places equal to ``_cut`` when ``_take_cut``.

    ``slim(_source, _place, size)``, ``budgets(_source, _budget)``. Each round sums the words of one more group of
    digits, only for documents inside the bucket that crosses the budget.
    """
    state = budgets.select("_source", "_budget", F.lit("").alias("_prefix"), F.lit(0).cast("long").alias("_below"))
    rest = slim
    for digits in range(STEP_DIGITS, PLACE_DIGITS + 1, STEP_DIGITS):
        bucket = F.substring("_place", 1, digits)
        sums = rest.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n"))
        # At most 4096 buckets a source: one row each, whatever the number of documents.
        over = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = lookup(sums, state.select("_source", "_budget", "_below"), ["_source"], how="inner")
        run = run.withColumn("_upto", F.col("_below") + F.sum("_words").over(over))
        crossing = run.where((F.col("_upto") > F.col("_budget")) & (F.col("_upto") - F.col("_words") <= F.col("_budget")))
        state = settle(
            crossing.select("_source", "_budget", F.col("_bucket").alias("_prefix"), (F.col("_upto") - F.col("_words")).alias("_below"), "_words", "_n")
        )
        if state.where("_n > 1").isEmpty() or digits == PLACE_DIGITS:
            break
        inside = lookup(slim, state.select("_source", "_prefix"), ["_source"], how="inner")
        rest = inside.where(F.substring("_place", 1, digits) == F.col("_prefix")).drop("_prefix")
    # The document (or ties) on the budget's edge: taken when that comes nearer to the budget.
    nearer = F.col("_words") - (F.col("_budget") - F.col("_below")) < F.col("_budget") - F.col("_below")
    return state.select("_source", F.col("_prefix").alias("_cut"), nearer.alias("_take_cut"))


def _named_source(source: str) -> Column:
    # A null source is a source of its own; null keys never join, so sources are renamed.
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def mixing_plan(slim: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per ``_source`` of ``slim(_source, _place, size)``: how often to take which places."""
    sizes = slim.groupBy("_source").agg(F.sum("size").alias("source_size"))
    real = F.when(F.col("_source") != "n", F.expr("substring(_source, 2)"))
    targets = settle(source_targets(sizes.select(real.alias("source"), "source_size"), weights, share, most)).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source"), "source_size", "target"
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.col("target") - F.col("_whole") * F.col("source_size")
    planned = targets.withColumn("_whole", whole).withColumn("_budget", budget)
    cuts = _thresholds(slim, planned.where("source_size > 0").select("_source", "_budget"))
    return settle(planned.join(cuts, "_source", "left").drop("_budget"))


def _copies() -> Column:
    cut_place = F.expr("substring(_place, 1, length(_cut))")
    below = (cut_place < F.col("_cut")) | ((cut_place == F.col("_cut")) & F.col("_take_cut"))
    return F.col("_whole") + F.coalesce(below, F.lit(False)).cast("long")


def mix_sources(
    docs: DataFrame,
    source: str = "source",
    keys: Sequence[str] = ("doc_id", "text"),
    size: Column | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Per document: ``keep``, ``size``, ``source_size``, ``target`` (its source's) and ``taken`` (words, repeats counted).

    A source whose target is ``r`` times its size takes every document ``floor(r)`` times and those below its
    threshold once more. A null source is a source of its own; null keys count as empty; documents without words take
    0; an empty table gives no rows. Repeated rows share a place and are taken alike. Other columns of ``docs`` are
    ignored, whatever their names. The result depends on the rows only, so reruns agree.
    """
    size = word_count(F.col("text")) if size is None else size
    # Keys may hold whole texts, so only their hash is settled.
    slim = settle(
        docs.select(
            *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
            _named_source(source).alias("_source"),
            place(*[F.col(k) for k in keys]).alias("_place"),
            size.alias("size"),
        )
    )
    plan = mixing_plan(slim.select("_source", "_place", "size"), weights, share, most)
    return lookup(slim, plan, ["_source"], how="inner").select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
        "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    source: str = "source",
    keys: Sequence[str] = ("doc_id", "text"),
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix_sources` takes it, with all its columns.

    Texts are read twice and never shuffled: only the plan, one row a source, is joined to them.
    """
    source_of, place_of = _named_source(source), place(*[F.col(k) for k in keys])
    slim = settle(docs.select(source_of.alias("_source"), place_of.alias("_place"), word_count(F.col("text")).alias("size")))
    plan = mixing_plan(slim, weights, share, most)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    placed = docs.select(row, source_of.alias("_source"), place_of.alias("_place"))
    chosen = lookup(placed, plan, ["_source"], how="inner", keys_of=slim)
    repeated = chosen.select("_row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))).alias("_copy"))
    return repeated.select("_row.*")
