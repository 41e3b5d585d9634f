"""Spelling variants: words one edit apart, grouped under the commonest of them.

All words, and all words reversed, form tries whose unary stretches are single edges. A frontier of states
(word, position, node, edits) is joined with the distributed table of edges, level by level: a state follows the edge that spells
its word and, where an edit is allowed, those that differ from it by one. A state with one edit that ends where a word of the
trie ends has found a neighbour.

The edit of a pair lies in the second half of the shorter word or in the first. The first kind is found in the trie
of words and the second in that of reversed words, so no state may edit near a root, where nearly every branch would match.
For the same reason each trie begins ``least_length // 2`` letters deep: there is one per beginning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanferry.operators.joins import lookup
from spanferry.shared import scratch_path, settle

RUNS = "[a-zÀ-ÿ]+"  # of texts with A-Z in lower case
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 6, 5, 5
DAMAGE = 199  # a run whose hash this number divides loses a code point
COUNTED_AT_ONCE = 100_000  # distinct words a task counts before it hands them on
SLICE_CHARS = 1 << 20  # characters of a text read at once; cut between runs, so slices never show


def word_counts(docs: DataFrame, doc_id: str, text: str, least_length: int, damage: int) -> DataFrame:
    """``(word, n)``: every run of letters of at least ``least_length`` code points, after lower-casing and damage.

    Runs are counted within a task before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        runs, outside = re.compile(RUNS), re.compile(f"[^{RUNS[1:-2]}]")

        def slices(body: str) -> Iterator[str]:
            at = 0
            while len(body) - at > SLICE_CHARS:
                cut = outside.search(body, at + SLICE_CHARS)
                yield body[at : (end := cut.start() if cut else len(body))]
                at = end
            yield body[at:]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                if not body.is_valid:
                    continue
                raw = body.as_buffer().to_pybytes().lower().decode("utf-8", "replace")
                prefix = crc32(f"{key.as_py() if key.is_valid else ''}:".encode())
                for part in slices(raw):
                    for word, n in Counter(runs.findall(part)).items():
                        h = crc32(word.encode(), prefix)
                        if not h % damage:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least_length:
                            total[word] += n
                    if len(total) > COUNTED_AT_ONCE:
                        yield flush()
        if total:
            yield flush()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _node(backward: bool, prefix: str) -> bytes:
    """Name of the node a prefix leads to: the prefix itself, or its digest where that is shorter."""
    raw = prefix.encode()
    return bytes([backward]) + raw if len(raw) <= 16 else bytes([backward + 2]) + blake2b(raw, digest_size=16).digest()


def _nodes(backward: bool, spelled: str, root: int) -> Iterator[bytes]:
    """Names of all nodes on a word's path, root first."""
    digest = blake2b(spelled[:root].encode(), digest_size=16)
    size = len(spelled[:root].encode())
    for depth in range(root, len(spelled) + 1):
        if depth > root:
            letter = spelled[depth - 1].encode()
            digest.update(letter)
            size += len(letter)
        yield _node(backward, spelled[:depth]) if size <= 16 else bytes([backward + 2]) + digest.digest()


_EDGE = "node binary, level int, label string, child binary, ends string, n long, more boolean"


def _path_rows(words: DataFrame, root: int) -> DataFrame:
    """A row per node on each word's two paths, with the letter after it ('' at the end, with the word's count)."""
    kinds = {"node": "binary", "backward": "boolean", "word": "string", "depth": "int", "next": "string", "n": "long"}
    arrow = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    types = [arrow[t] for t in kinds.values()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 2_000) for i in range(0, whole.num_rows, 2_000)):
                out = []
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for backward in (False, True):
                        spelled = word[::-1] if backward else word
                        last = len(spelled) - root
                        for i, node in enumerate(_nodes(backward, spelled, root)):
                            out.append((node, backward, word, root + i, spelled[root + i] if i < last else "", None if i < last else n))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], list(kinds))

    return words.select("word", "n").mapInArrow(rows, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def trie_edges(words: DataFrame, root: int) -> DataFrame:
    """``(node, level, children)`` for each node with edges; ``level`` counts the edges above it.

    A child is ``(label, child, ends, n, more)``: the letters of the edge, the node below it, the word that ends there with its
    count (else null), and whether edges go on. Letters number 90 at most, so children of a node are few.
    """
    path = scratch_path(words.sparkSession, "paths")
    _path_rows(words, root).write.parquet(path)
    rows = words.sparkSession.read.parquet(path)
    seen = rows.groupBy("node").agg(F.min("next").alias("least"), F.max("next").alias("most"), F.max("n").alias("n"))
    kept = settle(seen.where("least <> most or least = ''").select("node", "n", (F.col("most") != "").alias("more")))
    below = rows.where(F.col("depth") > root).select("node", "backward", "word", "depth")
    on_path = lookup(below, kept, ["node"], "inner")
    paths = on_path.groupBy("backward", "word").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "n", "more"))).alias("stops"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _EDGE.split(", ")]
        for batch in batches:
            out = []
            for backward, word, stops in zip(*(c.to_pylist() for c in batch.columns)):
                spelled = word[::-1] if backward else word
                above, depth = _node(backward, spelled[:root]), root
                for level, stop in enumerate(stops):
                    path = spelled[: stop["depth"]]
                    ends = None if stop["n"] is None else path[::-1] if backward else path
                    out.append((above, level, path[depth:], stop["node"], ends, stop["n"], stop["more"]))
                    above, depth = stop["node"], stop["depth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)

    types = [pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
    once = paths.mapInArrow(edges, _EDGE).groupBy("child").agg(F.min(F.struct("node", "level", "label", "ends", "n", "more")).alias("e"))
    return once.select("child", "e.*").groupBy("node", "level").agg(F.collect_list(F.struct("label", "child", "ends", "n", "more")).alias("children"))


def _step(states: DataFrame) -> DataFrame:
    """States after one edge; those that have found a word keep it in ``ends``.

    An edge that spells on is followed as it is. One that differs is followed where its first difference may be the edit: by
    replacement, found from the word with the smaller letter, or by one letter more, found from the shorter word.
    """
    edges = states.select("word", "spelled", "n", "allowed", "position", "edits", F.explode("children").alias("c"))
    size = "length(c.label)"
    ahead = F.expr(f"substring(spelled, position + 1, {size})")
    rest = edges.withColumn("ahead", ahead).where(
        (F.col("ahead") == F.col("c.label"))
        | (F.expr(f"edits = 0 AND position + {size} > allowed AND substring(c.label, 1, allowed - position) = substring(spelled, position + 1, allowed - position)"))
    )
    spells = F.col("ahead") == F.col("c.label")
    replaced = F.expr(f"length(ahead) = {size} AND ahead < c.label AND levenshtein(ahead, c.label, 1) = 1")
    longer = F.expr(f"length(spelled) >= position + {size} - 1 AND levenshtein(left(ahead, {size} - 1), c.label, 1) = 1")
    ends = F.expr(f"position + {size}")
    made = F.when(spells, F.array(F.struct(ends.alias("to"), F.col("edits").alias("made")))).otherwise(
        F.filter(
            F.array(
                F.struct(F.when(replaced, ends).alias("to"), F.lit(1).alias("made")),
                F.struct(F.when(longer, ends - 1).alias("to"), F.lit(1).alias("made")),
            ),
            lambda m: m["to"].isNotNull(),
        )
    )
    after = rest.select("word", "spelled", "n", "allowed", "c", F.explode(made).alias("m"))
    whole = F.expr("m.made = 1 AND m.to = length(spelled) AND c.ends IS NOT NULL")
    going = F.expr("c.more AND (m.made = 0 OR m.to < length(spelled))")
    return after.where(whole | going).select(
        "word", "spelled", "n", "allowed", F.col("m.to").alias("position"), F.col("c.child").alias("node"), F.col("m.made").alias("edits"),
        F.when(whole, F.col("c.ends")).alias("ends"), F.when(whole, F.col("c.n")).alias("ends_n"), going.alias("more"),
    )


def one_edit_pairs(words: DataFrame, root: int) -> DataFrame:
    """``(word, n, near, near_n)``: each pair of distinct ``words`` one edit apart, in both directions, once."""
    tries = settle(trie_edges(words, root))
    half = F.floor(F.length("word") / 2)
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    spelled = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    start = both.select("word", spelled.alias("spelled"), "n", F.when(F.col("backward"), F.length("word") - half).otherwise(half).cast("int").alias("allowed"), "backward")
    prefix = F.encode(F.expr(f"left(spelled, {root})"), "utf-8")
    node = F.concat(F.when(F.col("backward"), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), prefix)
    frontier = start.select("word", "spelled", "n", "allowed", F.lit(root).alias("position"), node.alias("node"), F.lit(0).alias("edits"))
    found, level = None, 0
    while True:
        rows = lookup(frontier, tries.where(F.col("level") == level).select("node", "children"), ["node"], "inner")
        states = settle(_step(rows))
        pairs = states.where("ends is not null").select("word", "n", F.col("ends").alias("near"), F.col("ends_n").alias("near_n"))
        found = pairs if found is None else found.unionByName(pairs)
        frontier = states.where("more").drop("ends", "ends_n", "more")
        if frontier.isEmpty():
            break
        level += 1
    turned = found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.unionByName(turned).distinct()


def variant_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    least_ratio: int = LEAST_RATIO, damage: int = DAMAGE,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word that occurs ``least_count`` times.

    ``n_near`` counts the words one edit away. ``form`` is the commonest of them (ties: smallest in code-point order) when it occurs
    at least ``least_ratio`` times as often, else null; ``root`` follows forms to the last, and is the word itself without one.

    Null texts have no words; a null id counts as empty text. Rows with equal ids and texts each count. Texts are read
    whole. Other columns are ignored whatever their names. An empty table, or one without such words, gives no rows.
    ``least_length`` must be 2 or more.
    """
    if least_length < 2:
        raise ValueError(f"least_length must be 2 or more; got {least_length}")
    root = min(least_length // 2, 4)  # the root's own prefix must be short enough to name its node
    words = settle(word_counts(docs, doc_id, text, least_length, damage).where(F.col("n") >= least_count))
    near = one_edit_pairs(words, root).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("form"))).alias("best")
    )
    known = lookup(words, settle(near), ["word"])
    chosen = -F.col("best.down") >= F.lit(least_ratio) * F.col("n")
    known = settle(known.select(
        "word", F.when(chosen, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, -F.col("best.down")).alias("form_n"),
    ))
    ends = settle(known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        # Every hop multiplies the count, so chains are short; each round doubles the distance covered.
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(lookup(ends, onward, ["root"]))
        if moved.where("next is not null").isEmpty():
            break
        ends = moved.select("word", F.coalesce("next", "root").alias("root"))
    return lookup(known, ends, ["word"]).select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
