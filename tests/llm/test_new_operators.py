"""Importance resampling, spelling variants and suffix dedup against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from spanferry.llm import importance, spelling, suffixes

SCHEMA = "doc_id long, text string, n long, word string, rank int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", 3) for i, t in rows], SCHEMA)


# --- suffix dedup -----------------------------------------------------------------------------------------------------


def _plain_repeats(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + least] for r in raws for p in range(len(r) - least + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if seen[raw[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def _repeat_texts(rng):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 30))) for _ in range(4)]
    texts = []
    for _ in range(70):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        texts.append(" ".join(parts))
    near = texts[0] + " " + texts[1]
    texts += [near] * 3 + [near[:70] + "#" + near[71:], near[5:] + "z"]
    return texts + [None, "", "a", "\0" * 200, "a" * 300, "ab" * 150, "x" * 39, "y" * 40, "y" * 40, near]


@pytest.mark.parametrize("block, slice_bytes", [(4_096, 1 << 20), (2, 1 << 20), (3, 97)])
def test_repeats_equal_plain_python(spark, monkeypatch, block, slice_bytes):
    monkeypatch.setattr(suffixes, "SLICE_BYTES", slice_bytes)
    texts = _repeat_texts(random.Random(block))
    ids = [i if i % 9 else None for i in range(len(texts))]
    got = suffixes.remove_repeats(_docs(spark, zip(ids, texts)), least=40, block=block).collect()
    want = [(i, *row) for i, row in zip(ids, _plain_repeats(texts, 40))]
    mine = [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["removed"]], bytes(r["kept"])) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_repeats_of_an_empty_table(spark):
    assert suffixes.remove_repeats(_docs(spark, [])).count() == 0


def test_two_stage_order_equals_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\x00\xff" if rng.random() < 0.5 else b"abc") for _ in range(rng.randint(0, 50)))
        flat = np.frombuffer(data, np.uint8)
        assert suffixes.two_stage_order(flat, 10**6).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        limit = rng.randint(1, 12)
        order = suffixes.two_stage_order(flat, limit).tolist()
        cut = [data[i : i + limit] for i in order]
        assert cut == sorted(cut)
        for length, a, b in zip(suffixes.common_prefixes(flat, np.array(order, np.int64), limit).tolist(), cut, cut[1:]):
            assert a[:length] == b[:length] and (length == min(len(a), len(b)) or a[length] != b[length])


# --- spelling variants ------------------------------------------------------------------------------------------------


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain_variants(rows, least_count=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and _near(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def _variant_rows(rng):
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["a" * k for k in (6, 7, 8, 11, 12, 300, 301)]
    vocabulary = []
    for stem in stems:
        vocabulary += [stem] * rng.choice([40, 160])
        for _ in range(5):
            i, letter = rng.randrange(len(stem)), rng.choice("abÀéz")
            made = rng.choice([stem[:i] + stem[i + 1 :], stem[:i] + letter + stem[i:], stem[:i] + letter + stem[i + 1 :]])
            vocabulary += [made] * rng.choice([1, 2, 7, 7, 8])
    vocabulary += ["chainword"] * 300 + ["chainwrd"] * 45 + ["chinwrd"] * 7
    vocabulary += ["z" * 5_000, "z" * 5_000 + "y"] * 6
    rng.shuffle(vocabulary)
    texts = [rng.choice([" ", ", ", "1", "\n"]).join(w.upper() if w.isascii() and rng.random() < 0.2 else w for w in vocabulary[i : i + 30]) for i in range(0, len(vocabulary), 30)]
    return [*enumerate(texts), (None, texts[0]), (None, texts[0]), (900, None), (901, ""), (902, "a b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    rows = _variant_rows(random.Random(seed))
    got = spelling.variant_groups(_docs(spark, rows)).collect()
    want = _plain_variants(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)


def test_variants_without_words(spark):
    assert spelling.variant_groups(_docs(spark, [])).count() == 0
    assert spelling.variant_groups(_docs(spark, [(1, "one two"), (2, None)])).count() == 0


# --- importance resampling --------------------------------------------------------------------------------------------


def _plain_draw(rows, target, run_words, least_words, percent):
    def cut(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return words, [crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, run_words + 1) for i in range(len(words) - n + 1)]

    cuts = [cut(t) for _, t in rows]
    s, t = Counter(b for _, f in cuts for b in f), Counter(b for x in target for b in cut(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    scored = []
    for (key, _), (words, found) in zip(rows, cuts):
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append([key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in scored if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for place, row in enumerate(able[: len(able) * percent // 100], 1):
        row[5] = place
    return sorted(map(tuple, scored), key=repr)


@pytest.mark.parametrize("run_words, slice_chars", [(1, 1 << 18), (3, 1 << 18), (3, 20)])
def test_draw_equals_plain_python(spark, monkeypatch, run_words, slice_chars):
    monkeypatch.setattr(importance, "SLICE_CHARS", slice_chars)
    rng = random.Random(run_words)
    words = ["apple", "BIRNE", "Éclair", "größe", "x1", "42", "日本"]
    text = lambda n: rng.choice([" ", "-", "\x00", "\t!"]).join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(120)]
    rows += [rows[5], rows[5], (None, text(40)), (None, None), (500, ""), (501, None), (502, "w" * 3_000), (503, text(5_000))]
    target = [text(20), None, "", "apple apple x1"]
    got = importance.resample(_docs(spark, rows), _docs(spark, enumerate(target)), run_words=run_words, drawn_percent=30).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _plain_draw(rows, target, run_words, 20, 30)


def test_draw_from_empty_tables(spark):
    empty = _docs(spark, [])
    assert importance.resample(empty, empty).count() == 0
    only = importance.resample(_docs(spark, [(1, "one two three")]), empty, least_words=3, drawn_percent=100).collect()
    assert [(r["n_features"], r["rank"]) for r in only] == [(3, 1)]
