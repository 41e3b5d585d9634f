"""Each operator on small inputs: against plain Python, and on nulls, empty tables, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanferry.llm import chat, chosenpath, licenses, mixture, packing, rpforest, tokentree, toxicity, warc, winnow
from spanferry.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lamda", "mu", "nu", "xi", "pi", "rho"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def documents(spark, rows):
    made = [(i, t, "en", s, None) for i, t, s in rows]
    return spark.createDataFrame(made, DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, "no id at all", "b"), (4, "one", "b"), (4, "one", "b"), (5, "one two three four five six", None)]


# Chat formatting


def test_chat_trees_rank_and_round_trip(spark):
    nasty = "\\### Assistant: </turn> ok \\b\\h\\l ####"
    rows = [
        ("t", 1, None, "user", nasty, 0.0), ("t", 2, 1, "assistant", "yes" + nasty, 1.0), ("t", 3, 1, "assistant", None, 5.0),
        ("t", 4, 3, "us:er", "x</turn>\n", 5.0), ("t", 9, 8, "user", "lost parent", None), ("t", 20, 21, "user", "circle", None),
        ("t", 21, 20, "user", "circle", None), ("t", 22, 21, "user", "on a circle", None), (None, 1, None, "user", "no tree", None),
        ("t", 2, 1, "assistant", "yes" + nasty, 1.0),
    ]
    table = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    done = chat.format_conversations(table.withColumn("leaf_id", F.lit("clash")))
    out = {r.leaf_id: r for r in done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_masked(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert set(out) == {2, 4, 9}
    assert out[4].path_rank == 1 and [(t.role, t.text) for t in out[4].turns] == [("user", nasty), ("assistant", ""), ("us:er", "x</turn>\n")]
    assert out[2].loss == ["yes" + nasty] and out[4].loss == [""]
    for r in out.values():
        for m, text in zip(r.mask, r.loss):
            cut = r.formatted[m.start : m.start + m.length]
            assert len(cut) == m.length and (text == "") == (cut == "")
    assert [r.leaf_id for r in chat.format_conversations(table, branches=1).collect()] == [4]
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_long_thread(spark):
    rows = [("t", i, i - 1, "assistant" if i % 2 else "user", f"turn {i}", None) for i in range(600)]
    table = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    r = chat.format_conversations(table).select("*", chat.read_masked(F.col("formatted"), F.col("mask")).alias("loss")).first()
    assert r.n_turns == 600 and r.loss == [f"turn {i}" for i in range(1, 600, 2)]
    assert all(r.formatted[m.start : m.start + m.length] == t for m, t in zip(r.mask, r.loss))


# Winnowing


def plain_winnow(hashes, w):
    if not hashes:
        return []
    out = []
    for a in range(max(len(hashes) - w + 1, 1)):
        window = hashes[a : a + w]
        least = min(window)
        at = a + max(i for i, h in enumerate(window) if h == least)
        if at not in out:
            out.append(at)
    return out


def test_winnowing_positions_and_guarantee(spark):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 12, 200)] + ["a b a b a b a b a b a b a b a b a b"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = winnow.with_fingerprint(table, "t", "f", 3, 4).select("t", "f", winnow.described(F.col("f")).alias("d")).collect()
    for r in rows:
        words = r.t.split()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        found = [2**31 - 1 - (x & (2**31 - 1)) for x in r.f]
        if len(words) < 3:
            assert len(r.f) == (1 if words else 0)
            continue
        known = {grams[p]: x >> 31 for p, x in zip(found, r.f)}
        # Every window holds a chosen position, and the chosen one is its least, rightmost hash.
        for a in range(max(len(grams) - 3, 1)):
            assert any(a <= p < a + 4 for p in found)
        assert len(known) == len({grams[p] for p in found})
        assert [int(p.split("@")[1]) for p in r.d.split()] == found


def test_winnow_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40), "a") for i in range(30)] + [(40, None, "a"), (41, "", "a"), (42, "same text here", "a"), (43, "same text here", "a")]
    got = {r.doc_id: r for r in winnow.edit_likeness(documents(spark, rows).withColumn("edited", F.lit(1))).collect()}
    order = sorted(rows, reverse=True)
    for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1]):
        t, n, half = t or "", n or "", len(t or "") // 2
        assert got[i].edited == t[: len(t) - half] + n[:half]
        assert 0 <= got[i].near_edited <= 1 and (got[i].near_next == 1.0) == ((t or "") == (n or "")), i
    assert winnow.edit_likeness(documents(spark, [])).count() == 0
    assert winnow.edit_likeness(documents(spark, ODD)).count() == len(ODD)


# Near duplicates


def plain_components(rows):
    sets, lower = [], str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    ids = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and ids[i] != ids[j]:
                    ids[i] = ids[j] = min(ids[i], ids[j])
                    changed = True
    return {i: (len(s), ids[i]) for i, s in sets}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        base = prose(rng, rng.choice([3, 30, 120])).split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = "Changed"
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_in_crowded_nodes(spark, monkeypatch):
    """One group of near copies, some linked only through others, beyond what one node or one group of partners takes."""
    monkeypatch.setattr(chosenpath, "SMALL_NODE", 40)
    monkeypatch.setattr(chosenpath, "PAIRS_A_GROUP", 5)
    rng = random.Random(11)
    base = prose(rng, 150).split()
    rows = []
    for i in range(70):
        copy = list(base)
        for at in range(0, i % 35, 7):
            copy[(at * 5 + i) % len(copy)] = f"changed{i}"
        rows.append((200 - i, " ".join(copy)))
    rows += [(900 + i, prose(rng, 40)) for i in range(10)] + [(500, rows[0][1]), (500, rows[0][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == plain_components(rows)


def test_passes_look_at_open_nodes_alone(spark, monkeypatch):
    """Sets whose nodes one pass closed are not looked up in the next."""
    seen, opened, pivoted = [], chosenpath._open, chosenpath._with_pivots

    def counted(paths, linked, every=False):
        if not every:
            seen.append(paths.count())
        return opened(paths, linked, every)

    def some(members, signs, turn, percent):
        found = pivoted(members, signs, turn, percent)
        return found.where("pmod(xxhash64(a, b), 4) <> 0") if turn == 1 else found  # a quarter is left to the next turn

    monkeypatch.setattr(chosenpath, "_open", counted)
    monkeypatch.setattr(chosenpath, "_with_pivots", some)
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        base = prose(rng, 60).split()
        rows += [(len(rows) + k, " ".join([*base[:-1], f"end{k}"])) for k in range(2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == plain_components(rows)
    assert len(seen) > 2 and seen[0] == seen[1] == 120 and all(n <= 60 for n in seen[2:])


def test_sets_that_meet_in_many_nodes_are_compared_once(spark, monkeypatch):
    """Near copies on both sides of the bound stay open in most of their nodes: one level, each pair looked at once."""
    asked, levels, confirmed, opened = [], [], chosenpath._confirmed, chosenpath._open

    def seen(pairs, *rest):
        asked.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return confirmed(pairs, *rest)

    def counted(paths, linked, every=False):
        levels.append(every)
        return opened(paths, linked, every)

    monkeypatch.setattr(chosenpath, "_confirmed", seen)
    monkeypatch.setattr(chosenpath, "_open", counted)
    looked, compared = [], chosenpath._pairs_of_small

    def compare(groups, percent, forest):
        found = compared(groups, percent, forest)
        if not forest:
            looked.extend((r.a, r.b) for r in found.collect())
        return found

    monkeypatch.setattr(chosenpath, "_pairs_of_small", compare)
    rng = random.Random(23)
    base = prose(rng, 150).split()
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(3, 12)):
            copy[at] = f"changed{i}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == plain_components(rows)
    assert True not in levels and looked and len(looked) == len(set(looked)) and len(asked) == len(set(asked))


def test_sketches_rule_out_what_lies_clearly_below_the_bound():
    rng = np.random.default_rng(4)
    kept = {}
    for shared in (150, 171):  # of 200 a set: likenesses 0.600 and 0.747 (at the bound, 171 and 172 differ by little)
        found = []
        for _ in range(300):
            values = rng.integers(0, 2**64, 400 - shared, dtype=np.uint64)
            a, b = (np.frombuffer(chosenpath._summary(np.sort(x))[3], np.uint8) for x in (values[:200], values[200 - shared :]))
            found.append(chosenpath._likeness(a[None], b, np.array([400]), 75)[0] > 0)
        kept[shared] = np.mean(found)
    assert kept[150] < 0.2 and kept[171] > 0.99


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """10,000 whole texts a batch took an executor's memory; the session's own setting is back afterwards."""
    import pyarrow as pa

    from spanferry.shared import settle, small_batches

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda: spark.range(0, 5000, 1, 1).mapInArrow(lambda xs: (pa.record_batch([pa.array([x.num_rows])], ["n"]) for x in xs), "n long")
    before = spark.conf.get(setting)
    with small_batches(spark):
        stored = settle(sizes())
    assert max(r.n for r in stored.collect()) <= 1000 and spark.conf.get(setting) == before
    asked = []
    monkeypatch.setattr(packing, "settle", lambda df: asked.append(int(spark.conf.get(setting))) or settle(df))
    packing.pack_documents(documents(spark, [(1, "one", "a")]), public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(chosenpath, "settle", lambda df: asked.append(int(spark.conf.get(setting))) or settle(df))
    chosenpath.near_duplicates(documents(spark, [(1, "one", "a")])).count()
    assert asked[0] <= 1000 and asked[-1] <= 1000 and spark.conf.get(setting) == before


def test_one_per_class_keeps_one_row(spark):
    out = chosenpath.one_per_class(documents(spark, ODD).withColumn("class", F.lit(1)))
    assert out.columns[-1] == "class"
    assert sorted(str(r.text) for r in out.collect()) == sorted(["None", "", " \n\t ", "no id at all", "one", "one two three four five six"])
    assert chosenpath.one_per_class(documents(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_components_over_several_tasks(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(50)]
    parent = {}
    for a, b in links:
        low, high = sorted((parent.setdefault(a, a), parent.setdefault(b, b)))
        parent = {k: low if v == high else v for k, v in parent.items()}
    table = spark.createDataFrame(links, "a long, b long")
    for links_a_task in (20, 1000):
        assert {r.id: r.root for r in components(table, links_a_task).collect()} == parent
    assert components(table.limit(0)).count() == 0


def estimated_bytes(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    roots = components(chain, 10)
    assert estimated_bytes(roots) < 2**320
    assert {r.id: r.root for r in roots.collect()} == dict.fromkeys(range(61), 0)


def test_near_duplicates_settle_nothing_of_a_larger_estimate(spark, monkeypatch):
    from spanferry.shared import settle

    seen = []
    monkeypatch.setattr(chosenpath, "settle", lambda df: seen.append(settle(df)) or seen[-1])
    monkeypatch.setattr(chosenpath, "components", lambda links: components(links, 5))
    rng = random.Random(12)
    bases = [prose(rng, 60) for _ in range(4)]
    rows = [(i, f"{bases[i % 4]} end{i}") for i in range(24)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in chosenpath.near_duplicates(documents(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert got == plain_components(rows)
    assert len({component for _, component in got.values()}) == 4
    assert max(map(estimated_bytes, seen)) < 2**63


def test_settled_joins_keep_rows_and_types_without_their_estimate(spark):
    from spanferry.shared import settle

    small = settle(spark.range(1, 3).withColumn("odd name", F.when(F.col("id") == 1, "a")))
    assert estimated_bytes(small) < 1_000
    df = small.withColumn("n", F.array(F.lit(1), F.lit(None)))
    kind = df.schema
    for _ in range(12):
        df = settle(df.join(df.select("id"), "id").unionByName(df.where("false")))
        assert estimated_bytes(df) < 2**63
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in kind]
    assert sorted((r[0], r[1], r[2]) for r in df.collect()) == [(1, "a", [1, None]), (2, None, [1, None])]


# Mixing


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 30)), rng.choice(["a", "b", "c", None])) for i in range(400)] + ODD
    out = mixture.mix_sources(documents(spark, rows).withColumn("size", F.lit("clash"))).collect()
    assert len(out) == len(rows)
    targets, taken, sizes = {}, defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        targets[r.source_size] = r.target
        taken[r.source_size] += r.taken
    for size, target in targets.items():
        assert target <= 2 * size + 1e-6 and abs(taken[size] - target) <= 30
    assert abs(sum(targets.values()) - 1.5 * sum(targets)) < 1e-6
    docs = documents(spark, rows)
    mixed = Counter((r.doc_id, r.text) for r in mixture.mixed_documents(docs).collect())
    assert sum(len((t or "").split()) * n for (_, t), n in mixed.items()) == sum(r.taken for r in out)
    assert mixture.mix_sources(documents(spark, [])).count() == 0


# Packing


def test_packing_is_whole_and_tight(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    rng = random.Random(7)
    odd = ["İstanbul ΣΑΣ naïve don't <|endoftext|> x", "a\x1cb é 漢字", None, "", "it's 'quoted' 12.5% <b>bold</b> IDIOT,"]
    rows = [(i, prose(rng, rng.choice([2, 50, 400, 1500])), "a") for i in range(40)] + [(100 + i, t, "a") for i, t in enumerate(odd)] + ODD[-3:]
    got = packing.pack_documents(documents(spark, rows).withColumn("piece", F.lit(0)), path, capacity=512, keep_ids=True).collect()
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(known.encode(t or "", add_special_tokens=False).ids + [1])
    bins = defaultdict(list)
    for r in got:
        assert any(x[r.start : r.start + 512] == list(r.ids) for x in texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(x) for xs in texts.values() for x in xs)
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 512
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        space, sums = rng.randint(1, 60), {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        found = packing.fullest(counts, space)
        assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= space)
        assert all(n <= counts[x] for x, n in found.items())


# Nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(600, 8))
    vectors[50:90] = vectors[50]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [None] + [1.0] * 7), (1003, [float("nan")] + [1.0] * 7), (1004, [1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = rpforest.nearest(table.withColumn("rank", F.lit(1)), 5, F.col("vec_id") % 10 == 0).collect()
    exact = np.array([v for _, v in rows])
    for q in range(0, 600, 10):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        scores = exact @ exact[q]
        best = [i for i in np.lexsort((np.arange(600), -np.round(scores, 12))) if i != q][:5]
        assert [m[1] for m in mine] == best and len(mine) == 5
    assert rpforest.nearest(table.limit(0), 5).count() == 0
    assert rpforest.nearest(table.where("vec_id < 3"), 5).count() == 6


# Toxicity


def test_toxicity_learns_stems_and_languages(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(rng, 30).split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["Grumblo,", "snarfing", "snarfed", "snarfs"])
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None, None, "s", 0), (5001, "", "xx", "s", 0), (None, "snarfing", "en", "s", 0)], DOCS)
    marks = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, marks).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    held = [(r.toxicity >= 0.7, r.doc_id % 4 == 0) for r in out if r.h and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.toxicity <= 1 for r in out) and not [r for r in out if r.doc_id in (5000, 5001) and r.rejected]
    kept = toxicity.clean_documents(docs.withColumn("toxicity", F.lit("clash")), marks)
    assert kept.columns == [*docs.columns, "toxicity"] and kept.where("doc_id < 900").count() > 600
    assert toxicity.score_documents(docs, marks.limit(0)).where("rejected").count() == 0
    assert toxicity.score_documents(docs.limit(0), marks).count() == 0


def test_long_text_scores_like_its_chunks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(11)
    texts = pa.array([prose(rng, 300), "snarfing " + prose(rng, 200), "", "one", prose(rng, 90)])
    features, bounds = toxicity.word_features(texts)
    labels = np.array([0, 1, 0, 0, 1], np.float32)
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 1)
    model = toxicity.train(features, bounds, labels, np.arange(5))
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 7)
    assert np.allclose(model.scores(texts), whole, atol=1e-6)


# WARC


def test_warc_round_trip_and_push_down(spark, tmp_path):
    warc.register(spark)
    rows = [(1, "u\r\n1", "<p>a\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "same"), (3, "u3", "same"), (4, "u4", None), (5, "u5", ""), (6, "u6", "é" * 300_000), (2, "u2", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = f"file://{tmp_path}/a"
    warc.records(pages).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    got = sorted(str((r.record_id, r.warc_type, r.refers_to, r.target_uri, bytes(r.payload or b"").decode(), r.payload_digest)) for r in back.collect())
    want = []
    for i, u, h in rows:
        h = h or ""
        first = min(j for j, _, x in rows if (x or "") == h)
        revisit = first != i
        want.append((f"urn:page:{i}", "revisit" if revisit else "response", f"urn:page:{first}" if revisit else None, u, "" if revisit else h, warc.payload_digest(h.encode())))
    assert got == sorted(map(str, want))
    assert {r.record_id for r in back.where("warc_type = 'revisit' and refers_to in ('urn:page:4')").collect()} == {"urn:page:5"}
    heads = spark.read.format("warc").option("payload", "false").load(path)
    assert heads.where("payload is not null").count() == 0 and heads.count() == 7
    warc.records(pages.limit(0)).write.format("warc").mode("append").save(f"file://{tmp_path}/b")
    assert spark.read.format("warc").load(f"file://{tmp_path}/b").count() == 0


def test_warc_reads_plain_archives_and_skips_bodies():
    body = b"x" * 700_000
    data = b"".join(warc.record_bytes({"warc_type": k, "record_id": k, "payload": body}) for k in ("response", "metadata", "response"))
    rows = list(warc.read_records(io.BytesIO(data), False, lambda r: r["warc_type"] == "response", True))
    assert [len(r["payload"]) for r in rows] == [700_000] * 2
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(data[:-9]), False, lambda r: True, True))


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r.record_id for r in warc.records(pages, least_bytes=3).where("warc_type = 'revisit'").collect()} == {"urn:page:4"}
    digest = hashlib.sha1(b"ab").digest()
    import base64

    assert warc.records(pages).first().payload_digest == base64.b32encode(digest).decode()


# Licences


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    rows = [(1, "Intro text.\nReleased under the MIT licence.\nMore."), (2, f"Header\n\n{mit[:120]}\n{mit[120:]}\n\nend"), (3, "nothing here"), (4, None), (5, ""), (6, "released UNDER the mit License")]
    docs = documents(spark, [(i, t, "a") for i, t in rows]).withColumn("dice", F.lit("clash"))
    out = {r.doc_id: r for r in licenses.scan_licenses(docs, least=0.7).collect()}
    assert out[2].license == "MIT" and out[6].dice == 1.0 and {m.kind for m in out[2].license_matches} == {"paragraph", "text"} or out[2].license == "MIT"
    assert all(out[i].license is None and not out[i].license_matches for i in (3, 4, 5))
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def plain_notices(text, least=0.8):
    words = [w.replace("licenc", "licens") for w in re.findall(r"[^\W_]+", (text or "").lower())]
    grams = list(zip(words, words[1:]))
    parts = [(n, p) for n, group in licenses.NOTICES.items() for p in group] + list(licenses.full_texts().items())
    found = []
    for name, part in parts:
        known = licenses._words(part)
        want = set(zip(known, known[1:]))
        if 2 * len(want & set(grams)) < 0.5 * len(want):
            continue
        for s in range(len(grams)):
            if grams[s] in want:
                have = set(grams[s : s + len(known) - 1])
                n = len(have & want)
                dice = 2 * n / (len(have) + len(want))
                if dice >= least:
                    found.append((-n, -dice, name, s, min(len(known), len(words) - s)))
    kept = []
    for m in sorted(found):
        if not any(o[3] < m[3] + m[4] and m[3] < o[3] + o[4] for o in kept):
            kept.append(m)
    return sorted((s, name, n, round(-d, 9)) for _, d, name, s, n in kept), kept[0][2] if kept else None


def test_notices_inside_lines_and_paragraphs(spark):
    full, rng = licenses.full_texts(), random.Random(21)
    changed = full["GPL-2.0"].split()
    for _ in range(40):
        changed[rng.randrange(len(changed))] = "changed"
    commented = "\n".join(" * " + line for line in full["BSD-3-Clause"].replace("the copyright holder nor", "FooCorp nor").splitlines())
    cases = {
        1: ("Copyright (c) 2024 Jane Doe. Released under the MIT License.", ["MIT"]),
        2: ("All of it is released under the MIT licence, as agreed.", ["MIT"]),
        3: ("x " + licenses.TEMPLATES["GPL-2.0"][0] + " y", ["GPL-2.0"]),
        4: ("x " + licenses.TEMPLATES["GPL-3.0"][0] + " y", ["GPL-3.0"]),
        5: ("Copyright Jane\n" + full["BSD-2-Clause"] + prose(rng, 50), ["BSD-2-Clause"]),
        6: (prose(rng, 50) + "\n" + commented + "\n" + prose(rng, 9), ["BSD-3-Clause"]),
        7: (prose(rng, 90) + full["MIT"] + prose(rng, 90) + " Licensed under the Apache License,\n# Version 2.0. " + prose(rng, 9), ["MIT", "Apache-2.0"]),
        8: (" ".join(changed), ["GPL-2.0"]),
        9: ("Released under the MIT License. " * 3, ["MIT"] * 3),
        10: (None, []), 11: ("", []), 12: ("one", []), 13: ("the of the license is not released under version", []),
        14: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    }
    docs = documents(spark, [(i, t, "a") for i, (t, _) in cases.items()]).withColumn("license", F.lit("clash"))
    out = {r.doc_id: r for r in licenses.find_notices(docs.unionByName(docs.where("doc_id = 1"))).collect()}
    for i, (text, names) in cases.items():
        got = out[i].license_notices
        assert [m.license for m in got] == names, i
        assert ([(m.start, m.license, m.words, round(m.dice, 9)) for m in got], out[i].license) == plain_notices(text), i
    assert licenses.find_notices(docs.limit(0)).count() == 0


# Token trees


def test_token_tree_edits():
    counts = tokentree.PieceCounts(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(12)
    parts = ["a", "b ", " ", "  ", "\n", "'", "'ll", "s", "23", ".", "é", "\t", "漢", " \n "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 300])))
        tree = tokentree.TokenTree.of(text, counts)
        for _ in range(5):
            added = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 900])))
            text, _ = tree.edit(text, rng.randint(-2, len(text) + 2), rng.choice([0, 1, 40]), added, counts)
            assert tree.count == len(counts.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_token_counts_table(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counts = tokentree.PieceCounts(path)
    rows = [(1, "hello world " * 900, [(10, 3, "XY"), (5000, 0, "in the middle")]), (2, None, [(0, 0, "new")]), (3, "", None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at: int, removed: int, added: string>>")
    out = tokentree.count_edited(docs.withColumn("n_tokens", F.lit(1)), path, trees=True).collect()
    text = "hello world " * 900
    text = text[:10] + "XY" + text[13:]
    text = text[:5000] + "in the middle" + text[5000:]
    first = next(r for r in out if r.doc_id == 1)
    assert first.edited_tokens == len(counts.encoding.encode_ordinary(text)) == first.tree[1] and first.encoded_chars < 2500
    assert len(out) == 4 and next(r for r in out if r.doc_id == 2).edited_tokens == 1
    assert tokentree.count_edited(docs.limit(0), path).count() == 0


def test_word_ids_are_the_tokenizers_and_common_words_outlive_a_full_cache(monkeypatch):
    from spanferry.llm import tokens

    encoded = []

    class Counted(tokens.WordIds):
        def __missing__(self, piece):
            encoded.append(piece)
            return super().__missing__(piece)

    monkeypatch.setattr(tokens, "CACHED_WORDS", 200)
    known = Counted(public_tokenizers.path("word_bpe_49k.json"))
    letters = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    common = " ".join(letters[:40])
    for n in range(100):
        rare = " ".join(f"x{a}{letters[n]}" for a in letters[:30])
        text = f"{common} {rare}, It'S n°{n}! ÀÉ\x00\x85é 中文{n} ﬁn'll İx"
        assert known.ids(text).tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
    assert known.ids("a<|endoftext|>B").tolist() == known.tokenizer.encode("a<|endoftext|>B", add_special_tokens=False).ids
    assert len(known) < 300 and all(encoded.count(word) == 1 for word in letters[:40])


def test_later_trees_send_only_what_beats_the_first(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    sent, apply = [], PandasCogroupedOps.applyInArrow

    def kept(self, *args):
        sent.append(apply(self, *args))
        return sent[-1]

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", kept)
    vectors = np.random.Generator(np.random.PCG64(3)).normal(size=(1500, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.rank): r.vec_id for r in rpforest.nearest(table, 5, F.col("vec_id") % 50 == 0, recall=1.0, sample_rows=1000).collect()}
    first, later = (df.select("q", "rep", "score").distinct().collect() for df in sent[:2])
    scores = defaultdict(list)
    for r in first:
        scores[r.q].append(r.score)
    bars = {q: sorted(s)[-6] for q, s in scores.items() if len(s) > 5}
    assert bars and later and all(r.score >= bars[r.q] - 1e-6 for r in later if r.q in bars)
    near = {q: [int(i) for i in np.argsort(-(vectors @ vectors[q]), kind="stable") if i != q][:5] for q in range(0, 1500, 50)}
    assert np.mean([found[q, n + 1] == i for q, ids in near.items() for n, i in enumerate(ids)]) > 0.9
