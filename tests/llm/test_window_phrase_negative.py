"""Online packing, phrases and hard negatives against plain versions, on planted and odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake.llm import hard_negatives, online_packing, phrases

DOCS = "doc_id long, text string, lang string, source string, n int, a string, f string, k int, sequence_id string, start string"


def odd_documents():
    r = np.random.default_rng(8)
    vocab = ["".join(r.choice(list("abcdefgh"), r.integers(1, 5))) for _ in range(60)]
    prose = lambda n: "".join(w + (" ", ", ", ". ", "\n", "\t")[min(4, int(r.geometric(0.7)) - 1)] for w in r.choice(vocab, n))
    texts = [None, "", "  \n", "a", "A b", "Straße È ÄB " * 40, "new york city. " * 300, "of the " * 2000, prose(40_000), *[prose(int(n)) for n in r.integers(1, 900, 60)]]
    rows = [(i, t, (None, "en", "und", "de")[i % 4]) for i, t in enumerate(texts)] + [(None, texts[9], "en"), (None, None, None), (10, texts[10], "de")]
    return [(*x, "s", 1, "a", "f", 2, "q", "t") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- windows by the sum of squares


def plain_windows(sizes, capacity):
    """The rule written out: every possible place tried, the sum of squares counted anew."""
    windows, out = [], []
    for s in sizes:
        def cost(at, s=s):
            after = [w + s if k == at else w for k, w in enumerate(windows)] + ([s] if at is None else [])
            return sum(n * n for level, n in Counter(after).items() if level < capacity)
        places = [(cost(k), -w, k) for k, w in enumerate(windows) if w + s <= capacity] + [(cost(None), 0, None)]
        best = min(places, key=lambda p: p[:2])[2]
        if best is None:
            windows.append(s)
            best = len(windows) - 1
        else:
            windows[best] += s
        out.append(windows[best])
    return out


def test_levels_follow_the_sum_of_squares():
    r = np.random.default_rng(5)
    for capacity, top in ((16, 12), (32, 31)):
        sizes = [int(s) for s in r.integers(1, top, 250)]
        levels, got = online_packing.Levels(capacity), []
        for k, s in enumerate(sizes):
            at = levels.best(s)
            got.append(at + s)
            levels.put((k, 0, b"\0\0\0\0" * s, s))
        want = plain_windows(sizes, capacity)
        assert got == want


@pytest.mark.parametrize("least", [1, 4])
def test_finish_pads_nothing_but_a_short_rest(least):
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 5, 40):
        windows = sorted(([(k, 0, bytes(4 * int(s)), int(s))] for k, s in enumerate(r.integers(1, 64, n))), key=lambda w: -len(w[0][2]))
        sizes = [sum(len(p[2]) // 4 for p in w) for w in online_packing.finish([list(w) for w in windows], 64, least)]
        assert sum(sizes) == sum(len(w[0][2]) // 4 for w in windows)
        odd = [s for s in sizes if s & (s - 1)]
        assert len(odd) <= 1 and all(s < least for s in odd) and sizes.count(64) == sum(sizes) // 64


def check_packing(rows, docs, tokenizer, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    whole = Counter()
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
        whole[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    ids_of = defaultdict(list)
    for d, text in docs:
        ids_of[d].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], np.uint32))
    for r in rows:
        assert any(len(i) == r.doc_tokens and zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in ids_of[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(i) for x in ids_of.values() for i in x)
    for d, found in ids_of.items():  # every token of every document once
        cover = Counter(x for r in rows if r.doc_id == d for x in range(r.start, r.start + r.length))
        assert cover == Counter(x for i in found for x in range(len(i)))
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("most", [3, 4096])
def test_online_packing_whole(docs, tokenizer, most):
    rows = online_packing.pack_online(docs, tokenizer, capacity=256, max_open=most).collect()
    sizes = check_packing(rows, [(x[0], x[1]) for x in odd_documents()], tokenizer, 256)
    padded = sum(256 - s for s in sizes if s & (s - 1))
    assert padded <= 3 * 256 * (1 if most > 3 else 40) and (most == 3 or padded <= 0.05 * sum(sizes))
    again = online_packing.pack_online(docs, tokenizer, capacity=256, max_open=most).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_online_packing_empty_and_bound(spark, tokenizer):
    assert online_packing.pack_online(spark.createDataFrame([], DOCS), tokenizer).count() == 0
    levels_seen = []
    stream = ((k, bytes(4 * 200)) for k in range(1000))  # nothing fits together: windows pile up
    for w in online_packing.windows_of(stream, 256, max_open=10):
        levels_seen.append(sum(len(p[2]) // 4 for p in w))
    assert sum(levels_seen) == 200_000 and sum(1 for s in levels_seen if s & (s - 1)) <= 100
    assert levels_seen.count(256) >= 700


def test_online_packing_on_documents(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = online_packing.op11_online_packing(spark, data).collect()
    sizes = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 4096)
    assert sum(4096 - s for s in sizes if s & (s - 1)) <= 4096
    cut = Counter(r.doc_id for r in rows)
    assert sum(n > 1 for n in cut.values()) <= 0.4 * len(cut)


# ---- phrases


def plain_phrases(rows, min_count, top, covered):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang, low = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = defaultdict(list)
    for p, a in found.items():
        lang, *w = p
        cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [b for q, b in found.items() if len(q) > len(p) and q[0] == lang and (q[1:3] == p[1:] or q[2:4] == p[1:])]
        if all(100 * b < covered * a for b in longer):
            out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    rows = []
    for lang, x in out.items():
        rows += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])]
    return sorted(rows)


@pytest.mark.parametrize("sizes", [{}, {"budget": 40, "word_bits": 11, "pair_bits": 11, "slices": 8}, {"budget": 300, "word_bits": 8, "pair_bits": 16, "slices": 4}])
def test_phrases_are_counted_whole(docs, sizes):
    got = sorted(map(tuple, phrases.collocations(docs, min_count=4, top=50, **sizes).collect()))
    assert got == plain_phrases(odd_documents(), 4, 50, 50) and len(got) > 100


def test_phrases_blocks_and_empty(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "STEP_BYTES", 500)
    rows = odd_documents()[:8]
    small = spark.createDataFrame(rows, DOCS).coalesce(1)
    assert sorted(map(tuple, phrases.collocations(small, min_count=2).collect())) == plain_phrases(rows, 2, 2000, 50)
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame(rows[:3], DOCS)).count() == 0


def test_phrase_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    tree = spark.createDataFrame([("en", 1, "a", None, None, big + 1), ("en", 1, "b", None, None, big + 7), ("en", 2, "a", "b", None, big)], "lang string, k int, w1 string, w2 string, w3 string, f long")
    row = phrases.scored(tree).first()
    assert row.score == 10**6 * big * big // ((big + 1) * (big + 7)) and (row.l, row.r) == (big + 1, big + 7)


def test_a_hot_prefix_is_split(spark):
    texts = [("the " + " ".join(f"w{(i * 7 + j) % 97} the w{j % 5}" for j in range(50)),) for i in range(200)]
    frame = spark.createDataFrame([(t, "en") for (t,) in texts], "text string, lang string")
    seen = phrases.partition(frame, 4, 500, 12, 12, 8).collect()
    plan = phrases.Plan([r for r in seen if r.level], 12, 12, 8, 500)
    assert len(plan.hot) and len(plan.hot2)
    block = next(phrases.blocks_of([b for b in frame.toArrow().to_batches()]))
    gids = {(g, lv) for b in phrases._fragments(block, plan) for g, lv in zip(b.column("gid").to_pylist(), b.column("level").to_pylist(), strict=True)}
    assert {lv for _, lv in gids} == {1, 2, 3} and len(gids) > 20


# ---- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, norm string, key string, dim string"


def plain_negatives(rows, most=5):
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(object), lb) for i, v, lb, *_ in rows if i is not None and v and lb is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, v, lb in rows:
        if i % 10:
            continue
        met = sorted(((-int(v @ w), j, lw) for j, w, lw in rows if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for p, pid, _ in [x for x in met if x[2] == lb][:most]:
            inside = [(s, j) for s, j, lw in met if lw != lb and 80 * -p <= 100 * -s <= 100 * -p][:most]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j) in enumerate(inside)]
    return sorted(out)


def odd_vectors(n=700, d=24):
    r = np.random.default_rng(4)
    centre = r.normal(size=(6, d))
    rows = [(i, [float(np.float32(x)) for x in (centre[r.integers(6)] * r.choice([0, 1, 1.5]) + r.normal(size=d)) * r.lognormal(0, 0.3)], int(r.integers(0, 5)) if i % 13 else None) for i in range(n)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(150)]  # many copies
    rows += [(2000, None, 1), (2010, [], 1), (2020, [float("nan")] * d, 1), (2030, [None] * d, 1), (None, rows[1][1], 1), (2040, [0.0] * d, 2), (2050, [1.0, 2.0], 1), (2060, [1.5, 1.0], 1), (2061, [1.5, 0.9], 2), (2070, [-x for x in rows[3][1]], 77), (20, rows[21][1], 1)]
    return [(*x, 1, "v", "n", "k", "d") for x in rows]


@pytest.mark.parametrize("levels", [((0.4, 0.25), (0.9,)), ((0.95, 0.8), (0.99, 0.95)), ((), ())])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, levels):
    monkeypatch.setattr(hard_negatives, "POSITIVE_LEVELS", levels[0])
    monkeypatch.setattr(hard_negatives, "NEGATIVE_LEVELS", levels[1])
    monkeypatch.setattr(hard_negatives, "BLOCK", 200)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    rows = odd_vectors()
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 10 == 0).collect()
    want = plain_negatives(rows)
    assert sorted(map(tuple, got)) == want and len(want) > 300


def test_hard_negatives_empty(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame(odd_vectors()[1:3], VECTORS)
    assert hard_negatives.mine(one, F.lit(False)).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 19])
def test_threshold_pairs_are_whole(scale):
    r = np.random.default_rng(scale % 97)
    q, x = (np.rint(r.normal(size=(n, 40)) * r.lognormal(0, 1, (n, 1)) * 100 * scale / 10).astype(np.int64) for n in (30, 500))
    exact = (q.astype(object) @ x.T.astype(object))
    for share in (0.999, 0.9, 0.3, 0.0):
        floors = np.array([int(sorted(row)[int(share * 499)]) for row in exact], np.int64)
        i, k, s = hard_negatives.threshold_pairs(q, floors, x)
        want = {(a, b) for a in range(30) for b in range(500) if exact[a, b] >= floors[a]}
        assert set(zip(i.tolist(), k.tolist(), strict=True)) == want and len(i) == len(want)
        assert all(int(v) == exact[a, b] for a, b, v in zip(i, k, s, strict=True))


def test_threshold_pairs_omit_dimensions():
    """Lists are cut by suffix norms: with a high floor most products are never summed."""
    r = np.random.default_rng(1)
    x = np.rint(r.normal(size=(2000, 64)) * 1000 / (1 + np.arange(64))).astype(np.int64)
    q = x[:8] * 1
    floors = ((q.astype(float) ** 2).sum(1) * 0.8).astype(np.int64)
    rest = hard_negatives._rest(x.astype(float))
    kept = (rest[:, :64] * np.sqrt((q.astype(float) ** 2).sum(1)).max() >= floors.min()).sum(1)
    assert kept.mean() < 32 and len(hard_negatives.threshold_pairs(q, floors, x)[0]) >= 8
