"""Document fingerprints by winnowing, in DataFrame operations only.

Every run of ``k`` tokens is hashed; of every ``w`` consecutive hashes the smallest is chosen, the rightmost of equals,
and kept with its position. So two texts that share ``w + k - 1`` consecutive tokens share a chosen hash for certain,
and no match is shorter than ``k`` tokens. Tokens are words by default; another ``pattern`` gives letters or the like.

A hash and its position travel as one number, ``hash * 2**31 + (2**31 - 1 - position)``: the least number of a window is
the least hash at its rightmost place, and minima over ``w`` places take about ``log2(w)`` passes over the array.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanferry.shared import settle

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
K, W = 5, 8
ROWS_PER_BUCKET = 4096
_LAST = 2**31 - 1


def with_fingerprint(
    df: DataFrame, text: str, out: str, k: int = K, w: int = W, pattern: str = WORD_PATTERN
) -> DataFrame:
    """Add ``out``: ``array<bigint>`` of chosen hashes with positions, in text order; read it by :func:`hashes`
    and :func:`described`.

    Null counts as empty. Texts without a token have an empty fingerprint, shorter ones than ``k`` tokens are hashed
    whole, and shorter ones than a window keep their least hash. Equal texts have equal fingerprints.
    """
    if k < 1 or w < 1:
        raise ValueError("k and w must be positive")
    tokens, grams = f"_{out}_tokens", f"_{out}_grams"
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
    run = ", ".join(f"get({tokens}, i + {j})" for j in range(k))
    packed = f"cast(%s as bigint) * {2**31} + ({_LAST} - i)"
    whole = packed.replace(" - i)", ")") % f"hash({tokens})"
    hashed = F.expr(
        f"case when size({tokens}) = 0 then cast(array() as array<bigint>) when size({tokens}) < {k} then array({whole}) "
        f"else transform(sequence(0, size({tokens}) - {k}), i -> {packed % f'hash({run})'}) end"
    )
    df = df.withColumn(tokens, found).withColumn(grams, hashed).drop(tokens)
    least, reach, step = grams, 1, 0
    while reach < w:
        shift = min(reach, w - reach)
        following = f"_{out}_least_{step}"
        # Past the end there is nothing to compare with: least() skips nulls.
        df = df.withColumn(
            following, F.expr(f"zip_with({least}, slice({least}, {shift + 1}, size({least})), (a, b) -> least(a, b))")
        )
        df = df.drop(least) if least != grams else df
        least, reach, step = following, reach + shift, step + 1
    windows = F.expr(f"slice({least}, 1, greatest(size({least}) - {w - 1}, 1))")
    return df.withColumn(out, F.array_distinct(windows)).drop(grams, least)


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def described(fingerprint: Column) -> Column:
    """A fingerprint as text: ``hash@position`` entries in text order; positions count tokens from 0."""
    def entry(x: Column) -> Column:
        return F.concat(F.lower(F.hex(F.shiftright(x, 31).bitwiseAND(F.lit(2**32 - 1)))), F.lit("@"), F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST)))

    return F.array_join(F.transform(fingerprint, entry), " ")


def likeness(left: str, right: str) -> Column:
    """Jaccard likeness of two columns of :func:`hashes`, 0 to 1; two empty ones are alike."""
    shared = F.size(F.array_intersect(F.col(left), F.col(right)))
    either = F.size(left) + F.size(right) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def neighbours(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows bucketed so that each finds the next one, in falling ``doc_id`` (after the last: the first).

    Returns ``doc_id, text``, the place ``_nn, _id, _h``, ``_bucket`` and ``_guest``: a bucket's last row is followed
    by a guest, the first row of the next bucket. Null ids come last, ties are ordered by a hash of the text.

    Ids alone are range-partitioned; the first key of every partition (one row each) cuts the buckets, so texts are
    shuffled once and no bucket depends on how ids are spread.
    """
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.col(doc_id).isNotNull().cast("int").alias("_nn"),
        F.coalesce(F.col(doc_id), F.lit(0)).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"),
    )
    falling = [F.desc("_nn"), F.desc("_id"), F.desc("_h")]
    ids = settle(keyed.select("_nn", "_id", "_h"))
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = max(usual, -(-ids.count() // ROWS_PER_BUCKET))
    placed = settle(ids.repartitionByRange(cut, *falling).withColumn("_p", F.spark_partition_id()))
    # One row per range partition.
    firsts = placed.groupBy("_p").agg(F.max(F.struct("_nn", "_id", "_h")).alias("k")).orderBy("_p").collect()
    bounds = [{"n": r["k"]["_nn"], "i": r["k"]["_id"], "h": r["k"]["_h"]} for r in firsts]
    if not bounds:
        return keyed.withColumn("_bucket", F.lit(0)).withColumn("_guest", F.lit(False))
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    kind = "struct<n: int, i: bigint, h: bigint>"
    heads = f"from_json('{json.dumps([g[0] for g in groups])}', 'array<{kind}>')"
    parts = f"from_json('{json.dumps(groups)}', 'array<array<{kind}>>')"
    key = "struct(_nn as n, _id as i, _h as h)"
    keyed = keyed.withColumn("_group", F.expr(f"size(filter({heads}, b -> b >= {key})) - 1"))
    bucket = F.expr(f"_group * {width} + size(filter(get({parts}, _group), b -> b >= {key})) - 1")
    rows = keyed.withColumn("_bucket", bucket.cast("int")).drop("_group").withColumn("_guest", F.lit(False))
    guest_of = docs.sparkSession.createDataFrame(
        [(b["n"], b["i"], b["h"], (at - 1) % len(bounds)) for at, b in enumerate(bounds)], "_nn int, _id long, _h long, _at int"
    )
    # Broadcast bound: one row per range partition.
    guests = (
        rows.join(F.broadcast(guest_of), ["_nn", "_id", "_h"])
        .dropDuplicates(["_at"])
        .withColumn("_bucket", F.col("_at"))
        .withColumn("_guest", F.lit(True))
    )
    return rows.unionByName(guests.drop("_at"))


def edit_likeness(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W, pattern: str = WORD_PATTERN
) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are.

    The edit replaces the last ``floor(n / 2)`` code points by the first as many (or all) of the next row's text, see
    :func:`neighbours`. Returns ``doc_id, text, edited, fingerprint, edited_fingerprint`` (arrays), ``near_edited`` and
    ``near_next``. Nulls count as empty texts; a single row is its own neighbour; an empty table gives no rows;
    repeated rows each have a row. Extra columns are ignored.
    """
    dealt = neighbours(docs, doc_id, text).repartition("_bucket")
    marked = with_fingerprint(dealt, "text", "fingerprint", k, w, pattern)
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_nn"), F.desc("_id"), F.desc("_h"))
    paired = (
        marked.withColumn("_next", F.lead("text").over(order))
        .withColumn("_next_fingerprint", F.lead("fingerprint").over(order))
        .where(~F.col("_guest"))
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))
    both = with_fingerprint(paired.withColumn("edited", edited), "edited", "edited_fingerprint", k, w, pattern)
    sets = (
        both.withColumn("_own", hashes(F.col("fingerprint")))
        .withColumn("_theirs", hashes(F.col("edited_fingerprint")))
        .withColumn("_following", hashes(F.col("_next_fingerprint")))
    )
    return sets.select(
        "doc_id", "text", "edited", "fingerprint", "edited_fingerprint",
        likeness("_own", "_theirs").alias("near_edited"),
        likeness("_own", "_following").alias("near_next"),
    )
