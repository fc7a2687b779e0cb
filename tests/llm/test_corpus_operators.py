"""Operators on documents against plain versions, on planted and odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake.llm import components, language_id, line_dedup, mixing, near_dedup, packing, pii, quality_mil, quality_rules, substrings, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept int, size string, sequence_id int, score string"
rng = np.random.default_rng(3)
VOCAB = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCAB, n)).capitalize() + "."


def odd_rows():
    base, long = prose(120, 1), prose(30_000, 2)
    near = base.split()
    near[7] = "changed"
    texts = [None, "", " \n\t ", "a", "a", "zwei worte", base, base, base.upper().lower().capitalize(), " ".join(near), long, long + " tail", "\x00nul \x01 " * 30, "é" * 200, "| # |" * 40, "Und " * 100, base + "\n" + prose(60, 4)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, None), (6, base)]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 7, 1, "x", 3, "y") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_rules_figures(odd, empty):
    rows = quality_rules.clean_lines(odd, with_text=True).collect()
    assert len(rows) == odd.count() and quality_rules.clean_lines(empty).count() == 0
    text = {r[0]: r[1] for r in odd_rows()}
    for r in rows:
        if r.doc_id is None:
            continue
        t, w = text[r.doc_id] or "", words(text[r.doc_id])
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)), r.doc_id
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[6] and not kept[14] and not kept[15] and not kept[0]


def test_quality_rules_lines(spark):
    good = prose(60, 9)
    fine = ["Homework is due on the first day.", "Nextdoor they all sang songs.", "Searching for a way out, still."]
    kept = quality_rules.clean_lines(spark.createDataFrame([(1, "\n".join([good, *fine, "Home: start here and go on.", "NEXT to the last page, and on."]))], "doc_id long, text string"), with_text=True).first()
    assert kept.clean_text == "\n".join([good, *fine])
    text = "\n".join([good, "Home | News | About", "Subscribe to our letters today now", "We say all rights RESERVED in a line.", "SHOUTING WORDS ARE NOT FINE HERE.", "unfinished bit", "", good])
    row = quality_rules.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_text=True).first()
    assert row.clean_text == "\n".join([good, "", good]) and row.n_lines_failed == 5


def test_quality_rules_long_line_with_phrase(spark):
    import corpus_pipeline

    texts = [prose(400, 31) + " See the privacy policy there. " + prose(400, 32), prose(100, 33) + "\nClick here to read all of our privacy policy and terms of use."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: texts[1].split("\n")[0]}


def test_mixing_meets_targets(spark, odd, empty):
    r = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, ["a", "b", "c", None][min(3, int(r.integers(0, 6)) // 2 if i % 3 else 0)], int(r.integers(1, 400))) for i in range(4000)], "doc_id long, source string, size long")
    rows = mixing.mix(docs).select("doc_id", "source", "size", "mix.*").collect()
    assert len(rows) == 4000
    total = sum(x.size for x in rows)
    goal = {x.source: x.target for x in rows}
    size = {x.source: x.source_size for x in rows}
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 * total and all(goal[s] <= 2 * size[s] + 1e-6 for s in goal)
    taken = Counter()
    for x in rows:
        assert 0 <= x.copies <= 2
        taken[x.source] += x.copies * x.size
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 400
    again = mixing.mix(docs.repartition(7)).select("doc_id", "mix.copies").collect()
    assert sorted((x.doc_id, x.copies) for x in rows) == sorted(map(tuple, again))
    sized = odd.withColumn("_n", mixing.size_of("text"))
    assert mixing.mix(sized, size="_n").count() == odd.count() and mixing.mix(empty.withColumn("_n", mixing.size_of("text")), size="_n").count() == 0


def test_mixing_cells_and_clashing_names(spark, monkeypatch):
    rows = [(i if i % 4 else None, "a" if i % 3 else "b", 7 if i < 2000 else i % 50, i, "x", "y") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, class long, mix string, row string")
    whole = sorted(map(tuple, mixing.mix(docs).select("source", "size", "mix.target", "mix.copies").collect()))
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "size", "class", "row", "mix"]
    assert sorted(map(tuple, out.select("source", "size", "mix.target", "mix.copies").collect())) == whole


def test_line_dedup(spark, empty):
    rows = [(i, "h" if i < 8 else "one" if i == 8 else None, f"Menu\nbody {i}\n\n Menu ") for i in range(10)] + [(10, "h", None)]
    out = {r.page_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, host string, text string"), "host", "text").select("page_id", "line_dedup.*").collect()}
    assert out[0].text == "body 0\n" and (out[0].n_lines, out[0].n_dropped) == (3, 2)
    assert out[8].text == rows[8][2] and out[9].text == rows[9][2] and out[10].text is None and len(out) == 11
    assert line_dedup.dedup_lines(empty, "source", "text").count() == 0


def test_line_dedup_repeated_and_null_keys(spark):
    texts = ["Menu\nbody one", "first\nMenu", "Menu\nbody one", "clean\nalso clean"]
    rows = [(7, "h", t) for t in texts] + [(None, "h", "Menu\nno key"), (None, "h", "kept\nlines"), (None, None, "Menu\nno host"), (None, "h", None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "page_id long, host string, text string"), "host", "text").select("page_id", "host", "text", F.col("line_dedup.text").alias("left"), "line_dedup.n_dropped").collect()
    want = [(7, "h", texts[0], "body one", 1)] * 2 + [(7, "h", texts[1], "first", 1), (7, "h", texts[3], texts[3], 0), (None, "h", "Menu\nno key", "no key", 1), (None, "h", "kept\nlines", "kept\nlines", 0), (None, None, "Menu\nno host", "Menu\nno host", 0), (None, "h", None, None, 0)]
    assert Counter(map(tuple, out)) == Counter(want)


def test_line_dedup_clashing_names_and_many_lines(spark):
    many = "\n".join("Menu" if k % 2 else f"line {k}" for k in range(9000))
    rows = [(0, "h", many, 1, 2, "a")] + [(i, "h", f"Menu\nbody {i}", 1, 2, "a") for i in range(1, 5)]
    names = "row long, host string, text string, _key int, bad_h int, line_dedup string"
    out = {r[0]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, names).withColumnsRenamed({"_key": "places"}), "host", "text").collect()}
    assert out[0].line_dedup.text == "\n".join(f"line {k}" for k in range(0, 9000, 2)) and (out[0].line_dedup.n_lines, out[0].line_dedup.n_dropped) == (9000, 4500)
    assert out[3].line_dedup.text == "body 3" and (out[3].places, out[3].bad_h) == (1, 2)


def plain_near(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_against_all_pairs(spark, odd, empty):
    rows = []
    for g in range(60):
        base = words(prose(80, 100 + g))
        for c in range(int(np.random.default_rng(g).integers(1, 9))):
            r = np.random.default_rng(1000 * g + c)
            w = list(base)
            for k in r.integers(0, 80, int(r.integers(0, 7))):
                w[k] = VOCAB[int(r.integers(0, 900))]
            rows.append((len(rows), " ".join(w)))
    for size in (2, 5):
        want = plain_near(rows, size, 80)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size).collect()}
        assert got == want
    out = near_dedup.near_duplicates(odd, size=2).collect()
    want = plain_near([(r[0], r[1]) for r in odd_rows() if r[0] is not None], 2, 80)
    assert len(out) == odd.count() and all((r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id) for r in out if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None) and near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_star_of_edited_copies(spark):
    r = np.random.default_rng(77)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1201):  # each at 0.82 to the original, about 0.68 to another
        w = list(base)
        for k in r.choice(np.arange(2, 298, 5), 6, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    texts = [[set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows][k] for k in (0, 1, 2)]
    assert len(texts[0] & texts[1]) >= 0.8 * len(texts[0] | texts[1]) and len(texts[1] & texts[2]) < 0.8 * len(texts[1] | texts[2])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(x.component_id for x in got) == {0: 1201}


def test_near_dedup_crowded_pairs_without_hub(spark):
    r = np.random.default_rng(78)
    base, rows = [f"w{k}" for k in range(300)], []
    for i in range(300):  # copies of one text below 0.8 to each other, each with a partner of its own
        w = list(base)
        for k in r.choice(np.arange(2, 298, 5), 9, replace=False):
            w[k] = f"x{i}_{k}"
        p = list(w)
        for k in r.choice(np.arange(4, 298, 5), 5, replace=False):
            p[k] = f"y{i}_{k}"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(p))]
    want = plain_near(rows, 5, 80)
    assert len(set(c for _, c in want.values())) == 300
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_near_dedup_all_pairs_of_a_run(spark, monkeypatch):
    r = np.random.default_rng(79)
    rows = []
    for i in range(120):
        w = words(prose(100, 500 + i // 6))
        for k in r.integers(0, 100, int(r.integers(0, 9))):
            w[k] = f"z{i}_{k}"
        rows.append((i, " ".join(w)))
    sets = [set(zip(*(words(t.lower())[k:] for k in range(2)), strict=False)) for _, t in rows]
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    monkeypatch.setattr(near_dedup, "PART_ITEMS", 1500)
    open_ = spark.createDataFrame([(0, b"", i, len(x), i, sum(map(len, sets))) for i, x in enumerate(sets)], "tree int, prefix binary, id long, n long, c long, total long")
    got = near_dedup._all_pairs(open_, spark.createDataFrame(rows, "id long, text string"), 2, 80).collect()
    assert set(map(tuple, got)) == want and want


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(300 + i, 301 + i) for i in range(0, 50, 2)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()))
    assert all(got[i] == 0 for i in range(201)) and got[301] == 300 and len(got) == 201 + 50


def test_packing_round_trip(spark, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    extra = [(100 + i, prose(int(n), 50 + i)) for i, n in enumerate(np.random.default_rng(8).integers(1, 900, 300))] + [(900, "it's ÀÉ don't <|endoftext|> \x1c x y ﬁ 12ab c é I'LL")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.pack_documents(docs, path, groups=16).collect()
    text = {i: t for i, t, *_ in odd_rows()} | dict(extra)
    by_seq, total = defaultdict(list), Counter()
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            ids = np.array(model.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0], np.uint32)
            part = ids[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length and (r.length == 2048 or r.start + r.length == len(ids))
        total[r.doc_id] += 1
    for spans in by_seq.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    bound = sum(r.length for r in rows) / 2048
    assert len(by_seq) <= 1.08 * bound + 2 and set(text) <= set(total)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_near_the_volume_bound(spark, monkeypatch):
    r = np.random.default_rng(12)
    lengths = np.minimum(2048, np.exp(r.normal(5.6, 1.1, 40_000)).astype(int) + 1).tolist() + [300] * 9000
    monkeypatch.setattr(packing, "CELL_ROWS", 20)
    found = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(found).select("sequence_id", "offset", "length").collect()
    spans = defaultdict(list)
    for x in rows:
        spans[x.sequence_id].append((x.offset, x.length))
    assert sorted(x.length for x in rows) == sorted(lengths) and len(spans) <= 1.005 * sum(lengths) / 2048 + 1
    for s in spans.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= 2048


def test_configurations_cover_demand():
    for seed in range(5):
        r = np.random.default_rng(seed)
        sizes = sorted({int(x) for x in r.integers(30, 1000, 12)}, reverse=True)
        demand = [int(x) for x in r.integers(1, 400, len(sizes))]
        used = packing.configurations(sizes, demand, 1000)
        assert (sum(t * c for t, c in used) == np.array(demand)).all() and all((c * sizes).sum() <= 1000 for _, c in used)
        rooms = []  # first fit, longest first
        for size in (s for s, d in zip(sizes, demand, strict=True) for _ in range(d)):
            k = next((i for i, room in enumerate(rooms) if room >= size), None)
            if k is None:
                rooms.append(1000)
                k = len(rooms) - 1
            rooms[k] -= size
        assert sum(t for t, _ in used) <= len(rooms) + 1


def plain_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            x = b[k : k + length]
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_against_all_windows(spark, odd, empty, monkeypatch):
    r = np.random.default_rng(4)
    shared = [prose(int(n), 700 + k) for k, n in enumerate(r.integers(6, 60, 12))] + ["ab" * 200, "\x00" * 300, "x" * 51]
    rows = [(int(i), " ".join(x for k in range(int(r.integers(1, 4))) for x in (prose(int(r.integers(1, 60)), 5000 + 10 * int(i) + k), shared[int(r.integers(0, len(shared)))]))) for i in r.permutation(150)]
    rows += [(i, t) for i, t, *_ in [x for x in odd_rows() if x[0] is not None and x[0] not in (10, 11)]]
    rows = [(i + 1000 * (k >= 150), t) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 3000)
    got = sorted(map(tuple, substrings.remove_repeats(docs, digest=True).collect()))
    assert got == plain_repeats(rows, 50)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pacelake_blocks")]
    out = substrings.remove_repeats(odd).collect()
    assert len(out) == odd.count() and all(x.n_removed == 0 for x in out if x.doc_id is None) and substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 30])
def test_substrings_hot_passage_in_every_block(spark, monkeypatch, hot):
    passage, r = prose(40, 880), np.random.default_rng(9)
    rows = [(int(i), prose(int(r.integers(1, 30)), 6000 + int(i)) + " " + passage[: int(r.integers(100, len(passage)))] + prose(12, 7000 + int(i) % 9)) for i in r.permutation(160)] + [(900, "z" * 400), (901, "y" + "z" * 300), (902, "ab" * 100)]
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(substrings, "PART_BYTES", 4000)
    got = sorted(map(tuple, substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), digest=True, hot=hot).collect()))
    assert got == plain_repeats(rows, 50)


def test_same_bytes_tells_texts_apart():
    data = np.frombuffer(b"abcdefghijklmnop" * 2 + b"abcdefghijklmnoX" + bytes(8), np.uint8)
    words, at = substrings._words(data), np.array([0, 0, 0, 0])
    assert substrings.same_bytes(words, at, np.array([16, 32, 32, 1]), np.array([16, 16, 15, 3])).tolist() == [True, False, True, False]


def test_suffix_array_parts_merge():
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 99, int(n)).astype(np.uint8)) for n in r.integers(50, 90, 60)] + [b"a" * 70, b"a" * 55, b"\0" * 60]
    docs = r.integers(0, 50, len(texts))
    least = {}
    for t, d in zip(texts, docs, strict=True):
        for k in range(len(t) - 9):
            least[t[k : k + 10]] = min(least.get(t[k : k + 10], 99), d)
    for part in (100, 1 << 20):
        owners = substrings.window_owners(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), docs, 10, part)
        assert owners.tolist() == [least[t[k : k + 10]] for t in texts for k in range(len(t) - 9)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = substrings.suffix_array(data, 64)
    raw = data.tobytes()
    assert all(raw[a : a + 64] <= raw[b : b + 64] for a, b in zip(order, order[1:], strict=False))
    for k, n in list(enumerate(substrings.common_prefixes(data, order, 50)))[1:]:
        a, b = raw[order[k - 1] :], raw[order[k] :]
        m = 0
        while m < 50 and m < min(len(a), len(b)) and a[m] == b[m]:
            m += 1
        assert m == n


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(t):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_and_candidates(spark, odd, empty):
    texts = [
        "a@b.c_d@e.f and x.y+z@mail-1.example.co.uk. no@host @ a@b", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 0001.002.3.255 99999999999999999999.1.1.1", "é😀 4111 1111 1111 1111 then 4111-1111-1111-1112 and 41111111111111110000000", "+1 (555) 010-2345 and + 1 2 or +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
        "1 " * 4000, "9" * 9000, "a." * 5000 + "@", "+1" + " " * 3000 + "2", "\x01 me@x.io \x02", "card 4539 1488 0343 6467 call 555-010-9999 " * 3, None, "", "4111  1111 1111 1111 1", "1234567890123 4",
    ] + [f"Write to user{i}@site{i}.example.com or card 4111 1111 1111 1111 from 10.0.{i}.7, call +1 (555) 010-{1000 + i}." for i in range(30)] + ["Write to user77@localsite or 10.0.3"]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [tuple(s) for s in out[i].base] == plain_pii(t), (i, (t or "")[:60])
        spans = [tuple(s) for s in out[i].spans]
        assert set(map(tuple, out[i].base)) <= set(spans) and len(spans) == len(set(spans))
    assert len(pii.find(odd).collect()) == odd.count() and pii.find(empty).count() == 0


def test_pii_adds_planted_variants_and_leaves_decoys(spark):
    r = np.random.default_rng(21)
    phone = lambda i: f"({200 + i % 700}) 555-{1000 + i}"
    digits = lambda n: "".join(map(str, r.integers(1, 10, n)))

    def card(sep):
        d = "4" + digits(14)
        total = sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d)))
        d += str(-total % 10)
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    rows = []
    for i in range(400):
        text = [f"{prose(8, i)} call +1 {phone(i)} today", f"{prose(8, i)} write to user{i}@site{i % 7}.example.com now", f"{prose(8, i)} pay with card {card(' ')} soon", f"{prose(8, i)} server 10.{i % 200}.3.{i % 90} is up"][i % 4]
        rows.append((i, text))
    decoys = ["on 2024-01-15 12:30 it was", "part 12345678901234567890123 is out", "version 10.0.3 and 3.14159265", "we met at noon dot and then", "order 4539148803436468 failed", "look at home. Then go", "10.300.2.1 is none"]
    rows += [(1000 + i, f"{prose(5, 2000 + i)} {t} {prose(5, 3000 + i)}") for i, t in enumerate(decoys * 8)]
    planted = [(2000, "phone", f"please call {phone(3)} today"), (2001, "email", "write to user77 [at] site1.example.com now"), (2002, "email", "contact me.too at site2 dot example dot com now"), (2003, "card", f"pay with card {card('.')} soon"), (2004, "ip", "the server 10[.]1[.]3[.]17 is up")]
    rows += [(i, t) for i, _, t in planted]
    out = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, kind, t in planted:
        assert [k for _, k, _ in out[i].base] == [] and [pii.KINDS[k] for _, k, _ in out[i].spans] == [kind], (t, out[i])
        start, _, end = out[i].spans[0]
        assert t[start:end] == {2000: phone(3), 2001: "user77 [at] site1.example.com", 2002: "me.too at site2 dot example dot com", 2004: "10[.]1[.]3[.]17"}.get(i, t[14:33])
    for i, t in rows[400:-5]:
        assert out[i].spans == out[i].base, (t, out[i])
    for i, t in rows[:400]:
        assert [tuple(x) for x in out[i].base] == plain_pii(t) and len(out[i].base) == 1 and out[i].spans == out[i].base


def test_pii_many_spans_and_touching(spark):
    text = " ".join(f"user{i}@site.example.com" for i in range(3000))
    docs = spark.createDataFrame([(0, text), (1, None)], "doc_id long, text string")
    out = {x.doc_id: x for x in pii.find(docs).collect()}
    assert [tuple(x) for x in out[0].base] == plain_pii(text) and out[0].spans == out[0].base and out[1].base == []
    spans = [(0, 5, True), (3, 9, False), (9, 12, False), (12, 15, False), (14, 20, True), (20, 22, False), (25, 40, False), (30, 31, True), (50, 60, True), (55, 56, False), (70, 75, False), (70, 72, True)]
    rows = spark.createDataFrame([(1, *x) for x in spans], "row long, start int, end int, base boolean").select("*", pii._touches(F.col("base"), "row").alias("hit")).where("not base").collect()
    assert {(x.start, x.end): x.hit for x in rows} == {(s, e): any(b and s < y and x < e for x, y, b in spans) for s, e, f in spans if not f}


def test_pii_boosting_separates():
    code = np.arange(1 << 6)
    known = ((code & 1) & ((code >> 3) & 1)) * 50.0
    trees = pii.boost(code, np.full(64, 50.0), known)
    score = pii._scored(trees, code)
    assert score[known > 0].min() > score[known == 0].max()


def language_rows(n):
    base = {"en": "the of and to in that was with this from have", "de": "der die und den von das mit sich des auf nicht", "fr": "les des est pas que dans une pour vous avec être", "es": "los las una por que con para como más pero año"}
    r = np.random.default_rng(6)
    return [(i, " ".join(r.choice(base[lang].split(), int(r.integers(5, 60)))), lang) for i in range(n) for lang in [list(base)[i % 4]]]


def test_language_held_out(spark, odd, empty):
    rows = language_rows(800)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pacelake.llm import text as tx

    model = language_id.train(docs.where(~tx.held_out("doc_id")), "doc_id", "text", "lang")
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    test = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in test]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    out = language_id.identify(odd, model).collect()
    assert len(out) == odd.count() and all(r.lang_pred == "und" for r in out if r.doc_id in (0, 1, 2))
    assert language_id.train(empty, "doc_id", "text", "lang") is None and language_id.identify(odd, None).where("lang_pred != 'und'").count() == 0


def test_quality_model_learns(spark, odd, empty):
    rows = [(i, prose(int(np.random.default_rng(i).integers(20, 300)), i) if i % 3 else " ".join(f"{w}###" for w in words(prose(150, i)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality_mil.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_mil.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 3 > 0) for i in range(300, 400)]) > 0.95
    out = quality_mil.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_mil.train(empty, labels).flat == 0.5


def test_quality_score_equals_a_plain_pass_and_training_is_bounded(spark):
    rows = [(i % 60, prose(int(np.random.default_rng(i).integers(20, 300)), i) if i % 3 else " ".join(f"{w}###" for w in words(prose(150, i)))) for i in range(120)] + [(7, prose(20_000, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    seen = []
    fit, quality_mil.fit = quality_mil.fit, lambda bags, y: seen.append([len(b) for b in bags]) or fit(bags, y)
    try:
        model = quality_mil.train(docs, labels, max_rows=40, max_passages=10)
    finally:
        quality_mil.fit = fit
    assert len(seen[0]) == 40 and max(seen[0]) <= 10
    got = Counter((r.doc_id, round(r.score, 9)) for r in quality_mil.score(docs, model).collect())
    want, p = Counter(), model.p
    for i, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        z = (quality_mil.passages(raw, np.array([0, len(raw)]), 50)[0] - model.mean) / model.scale
        h = [np.tanh(x @ p["W"] + p["b"]) for x in z]
        e = [float((np.tanh(x @ p["V"]) / (1 + np.exp(-x @ p["U"]))) @ p["w"]) for x in h]
        a = np.exp(np.array(e) - max(e))
        want[i, round(float(1 / (1 + np.exp(-(sum(k * x for k, x in zip(a / a.sum(), h, strict=True)) @ p["c"] + p["d"])))), 9)] += 1
    assert got == want


def test_quality_gradients():
    r = np.random.default_rng(0)
    bags = [r.normal(size=(int(n), quality_mil.FEATURES)).astype(np.float32) for n in r.integers(1, 6, 12)]
    y = (np.arange(12) % 2).astype(float)
    model = quality_mil.fit(bags, y, width=5, epochs=1)
    x, bag = np.concatenate(bags).astype(float), np.repeat(np.arange(12), [len(b) for b in bags])
    g = model.gradients(x, bag, y)

    def loss():
        p = model.forward(x, bag, 12)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, i in (("W", (3, 2)), ("V", (1, 4)), ("U", (2, 2)), ("w", (3,)), ("c", (1,)), ("b", (0,))):
        old = model.p[k][i]
        model.p[k][i] = old + 1e-5
        up = loss()
        model.p[k][i] = old - 1e-5
        down = loss()
        model.p[k][i] = old
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-5


def test_top_k_against_products(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(700, 12)) * r.choice([0.1, 1, 4], (700, 1))
    v[::7] = v[7]
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)] + [(800, None), (900, [float("nan")] * 12), (1000, [None] * 12), (1100, [1.0] * 5), (1200, [0.5] * 5), (None, [1.0] * 12), (1300, []), (1400, [0.0] * 12)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in topk.top_k(docs, docs.where("vec_id % 100 = 0"), block=64, query_block=4, focus=4).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    ints = {i: np.floor(np.array(x, float) * 1024).astype(np.int64) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)}
    for q in [i for i in ints if i % 100 == 0]:
        every = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q]))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(every)]
    assert set(got) == {i for i in ints if i % 100 == 0}
    none = docs.where("vec_id < 0")
    assert topk.top_k(none, none).count() == 0


@pytest.mark.parametrize("kind", ["lengths", "outlier", "directions"])
def test_top_k_prunes_pairs_of_blocks(spark, kind):
    """On whole vectors: pairs of blocks that are met, of all, and results against all products."""
    r = np.random.default_rng(17)
    n, d = 6000, 24
    x = r.normal(size=(n, d))
    if kind == "directions":
        x = r.normal(size=(12, d))[r.integers(0, 12, n)] * 3 + x * 0.15
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    if kind != "directions":
        x *= r.lognormal(0, 1.2, (n, 1))
    if kind == "outlier":
        x[11] *= 1000
    docs = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    told = []
    got = topk.top_k(docs, docs.where("vec_id % 20 = 0"), block=200, query_block=20, told=told).collect()
    q_blocks = topk._blocks(topk.integers(docs.where("vec_id % 20 = 0"), "vec_id", "embedding"), 20).count()
    blocks = topk._blocks(topk.integers(docs, "vec_id", "embedding"), 200).count()
    assert sum(told) < 0.5 * q_blocks * blocks, (told, q_blocks, blocks)
    v = np.floor(x.astype(np.float32).astype(float) * 1024).astype(np.int64)
    mine = defaultdict(list)
    for g in sorted(got, key=lambda g: g["rank"]):
        mine[g.query_id].append((g.vec_id, g.score))
    assert len(mine) == n // 20
    for q, found in mine.items():
        score = v @ v[q]
        order = [i for i in np.lexsort((np.arange(n), -score)) if i != q][:10]
        assert found == [(i, int(score[i])) for i in order]


def test_top_k_blocks_by_bytes_and_repeated_ids(spark, monkeypatch):
    r = np.random.default_rng(15)
    rows = [(i if i < 300 else 7, [float(np.float32(c)) for c in x]) for i, x in enumerate(r.normal(size=(900, 16)))]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "BLOCK_BYTES", 16 * 8 * 20)
    most = topk._blocks(topk.integers(docs, "vec_id", "embedding"), 8192).select((F.length("ids") / 8).alias("n")).agg(F.max("n")).first()[0]
    assert most < 60
    got = {(x.query_id, x["rank"]): x.score for x in topk.top_k(docs, docs.where("vec_id in (0, 100)")).collect()}
    ints = [(i, np.floor(np.array(x) * 1024).astype(np.int64)) for i, x in rows]
    for q in (0, 100):
        v = dict(ints[:300])[q]
        assert [got[q, k] for k in range(1, 11)] == sorted((int(v @ x) for i, x in ints if i != q), reverse=True)[:10]


def thue_morse(k):
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_and_lines_that_polynomials_confuse(spark):
    one, other = thue_morse(11)
    r = near_dedup.near_duplicates(spark.createDataFrame([(1, one), (2, other), (3, f"{one} x"), (4, f"{other} x")], "doc_id long, text string"), size=2).collect()
    assert all(x.kept and x.component_id == x.doc_id for x in r)
    rows = quality_rules.clean_lines(spark.createDataFrame([(1, f"{one}\n{other}\n{one}"), (2, f"{one} b c {other} b c {one} b c")], "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_dup_lines, x.n_repeat_words) for x in rows} == {1: (1, 0), 2: (0, 6)}


def test_equal_hashes_are_told_by_bytes(monkeypatch):
    from pacelake.llm import text as tx

    monkeypatch.setattr(tx, "range_hashes", lambda data, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    data, at = tx.utf8(__import__("pyarrow").array(["x y\nx z\nx y\nlonger\nx z\n\n", "x y", None, "x z\nx z"]))
    figures, _ = quality_rules.judge(data, at, 1, 0.5)
    assert figures["n_dup_lines"].tolist() == [2, 0, 0, 1]


def test_range_hashes_depend_on_bytes_and_place():
    from pacelake.llm import text as tx

    r = np.random.default_rng(2)
    data = r.integers(0, 3, 4000).astype(np.uint8)
    starts = r.integers(0, 3900, 3000)
    ends = starts + r.integers(0, 60, 3000)
    h = tx.range_hashes(data, starts, ends)
    by = defaultdict(set)
    for k in range(3000):
        by[data[starts[k] : ends[k]].tobytes()].add(int(h[k]))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert (tx.range_hashes(data, starts, ends, 7) != h)[ends > starts].all()
    size = np.minimum(ends - starts, 40)
    other = r.integers(0, 3900, 3000)
    for step in (1, 37, 1 << 20):
        same = tx.same_ranges(data, starts[:300], other[:300], size[:300], step)
        assert same.tolist() == [bytes(data[a : a + n]) == bytes(data[b : b + n]) for a, b, n in zip(starts[:300], other[:300], size[:300], strict=True)]


def test_all_pairs_of_a_crowd_in_bounded_memory():
    """20,000 texts of five shingles of one template, in parts as they are dealt."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(3)
    meet = near_dedup._meet(80)
    tracemalloc.start()
    for places in ((0, 0), (0, 1)):
        sets = [np.sort(np.concatenate([[1, 2, 3], r.integers(10, 1 << 40, 2)]).astype(np.uint64)) for _ in range(4000)]
        sets[3999] = np.sort(np.append(sets[0], np.uint64(5)))  # five of six shared
        place = np.array([p for p in places for _ in range(2000)])
        key = (pa.scalar(0), pa.scalar(b""), pa.scalar(places[0]), pa.scalar(places[1]))
        out = meet(key, pa.table({"c": pa.array(np.arange(4000)), "place": pa.array(place), "items": pa.array([x.tobytes() for x in sets], pa.binary())}))
        assert out.to_pylist() == [{"a": 0, "b": 3999}]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_meet_finds_all_pairs(percent):
    import pyarrow as pa

    r = np.random.default_rng(percent)
    base = [r.integers(0, 400, 30) for _ in range(6)]
    sets = [np.unique(np.where(r.random(30) < r.choice([0.02, 0.1, 0.4]), r.integers(0, 2000, 30), base[k % 6])).astype(np.uint64) for k in range(240)]
    place = np.arange(240) % 2
    for i, j in ((0, 0), (0, 1), (1, 1)):
        keep = (place == i) | (place == j)
        table = pa.table({"c": pa.array(np.flatnonzero(keep)), "place": pa.array(place[keep]), "items": pa.array([sets[k].tobytes() for k in np.flatnonzero(keep)], pa.binary())})
        got = {(x["a"], x["b"]) for x in near_dedup._meet(percent)((None, None, pa.scalar(i), pa.scalar(j)), table).to_pylist()}
        want = {(min(a, b), max(a, b)) for a in np.flatnonzero(place == i).tolist() for b in np.flatnonzero(place == j).tolist() if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))}
        assert got == want


@pytest.mark.parametrize("variants", [20, 200, 2000])
def test_pii_variants_are_found_however_many_there_are(spark, variants):
    """200 base phones, variants of the same form without the plus sign, and decoys that fail the format or have another form."""
    rows = [(k, f"call +1 (200) 555-{1000 + k:04} today") for k in range(200)]
    rows += [(10_000 + k, f"call 1 (201) 555-{1000 + k:04} today") for k in range(variants)]
    decoys = [(50_000 + k, t) for k in range(60) for t in [(f"on 2021-03-{k % 28 + 1:02} we met", f"part no. {10_000_000 + k} was sold", f"sum of 12 {k + 10} 30 4 5 6 7 8 9 10 11 12 13 14 15 16", f"version 10.2.{k}.4.5 came")[k % 4]]]
    results = []
    for parts in (1, 4, 16):
        docs = spark.createDataFrame(rows + decoys, "doc_id long, text string").repartition(parts)
        results.append({r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find(docs).collect()})
    assert results[0] == results[1] == results[2]
    found = sum(len(results[0][10_000 + k][1]) == 1 for k in range(variants))
    assert found == variants and all(len(results[0][k][0]) == 1 for k in range(200))
    assert all(base == spans for i, _ in rows[:200] + decoys for base, spans in [results[0][i]])


def test_language_sample_is_bounded_and_shared(spark, monkeypatch):
    en, de = (["the house of my friend stands by the river and it is old", "they would never have thought of this"], ["das haus von meinem freund steht am fluss und ist alt", "daran haben sie noch nie gedacht"])
    rows = [(1, f"{en[k % 2]} {k}", "en") for k in range(500)] + [(2, f"{de[k % 2]} {k}", "de") for k in range(500)] + [(3, de[0], None), (None, de[0], "xx"), (4, None, "yy")]
    seen = []
    kept = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, langs: seen.append(Counter(langs)) or kept(x, langs))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.train(docs.repartition(p), "doc_id", "text", "lang", max_rows=100) for p in (1, 5)]
    assert seen == [Counter(en=50, de=50)] * 2
    assert all((a == b).all() for a, b in zip((models[0].weights, models[0].bias), (models[1].weights, models[1].bias)))
    few = spark.createDataFrame([(k, en[0], "en") for k in range(3)] + [(9, de[0], "de")] * 400 + [(k, f"{de[1]} {k}", "de") for k in range(10, 300)], "doc_id long, text string, lang string")
    language_id.train(few, "doc_id", "text", "lang", max_rows=50)
    assert seen[2] == Counter(en=3, de=47)
    got = Counter(r.lang_pred for r in language_id.identify(docs.where("doc_id < 3"), models[0]).collect())
    assert got == Counter(en=500, de=500)


def test_language_scores_against_sums_by_hand(spark):
    langs = {"en": "the house of my friend stands by the river", "de": "das haus von meinem freund steht am fluss", "fr": "la maison de mon ami est au bord du fleuve", "es": "la casa de mi amigo junto al gran rio"}
    rows = [(k, f"{t} {k} {t[: 5 + k % 20]}", lang) for k, (lang, t) in enumerate([*langs.items()] * 12)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    asked = [(1, "The House"), (2, "maison, FLEUVE!"), (3, "r\u00c9n\u00e9 a\u00fcs"), (4, "12 34"), (5, None), (6, "el gran amigo")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw, plain = text.encode(), []
        for k, b in enumerate(raw):  # letters of ASCII in lower case, what isn't a letter a blank, capitals of Latin-1 folded
            c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
            plain.append(c + 32 if k and raw[k - 1] == 0xC3 and 0x80 <= b <= 0x9E else c)
        plain = [c for k, c in enumerate(plain) if not (k and c == 32 and plain[k - 1] == 32)]
        sums, n = np.zeros(model.weights.shape[1]), 0
        for size in (2, 3, 4):
            for k in range(len(plain) - size + 1):
                key = sum(c << 8 * j for j, c in enumerate(plain[k : k + size]))
                sums += model.weights[((key + size * 0x1F123BB5) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language_id.BITS].astype(float)
                n += 1
        margin = sums / n + model.bias
        nf = len(model.families)
        p = np.exp(margin[:nf]) / np.exp(margin[:nf]).sum()
        best = int(p.argmax())
        inside = [k for k, x in enumerate(model.langs) if language_id._family(x) == model.families[best]]
        votes = dict.fromkeys(inside, 0.0)
        for c, (a, b) in enumerate(model.pairs):
            q = 1 / (1 + np.exp(-2 * margin[nf + c]))
            if a in votes:
                votes[a] += (q >= 0.5) + 1e-3 * q
                votes[b] += (q < 0.5) + 1e-3 * (1 - q)
        first = max(inside, key=lambda k: votes[k])
        share = min(1.0, votes[first] / (len(inside) - 1)) if len(inside) > 1 else 1.0
        assert got[i].lang_pred == model.langs[first] and abs(got[i].score - p[best] * share) < 1e-5


def test_long_blanks_in_every_block_are_sent_by_window(spark, monkeypatch):
    """An anchor with many bytes of runs in each block is hot by its bytes; the result is that of all windows."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 60_000)
    sent = []
    kept = substrings._again
    monkeypatch.setattr(substrings, "_again", lambda hot, hot_bytes: sent.append((hot, hot_bytes)) or kept(hot, hot_bytes))
    rows = [(k, f"{k} head " + " " * 50_000 + f" tail {k}" + "-+" * 40) for k in range(12)] + [(50, "x" * 49), (51, " " * 50), (52, None)]
    want = plain_repeats(rows, 50)
    for hot_bytes in (100_000, 32 << 20):
        got = sorted(map(tuple, substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), digest=True, hot_bytes=hot_bytes).collect()))
        assert got == want
    assert sent == [(5000, 100_000), (5000, 32 << 20)]
    place = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    import glob

    assert not glob.glob(f"{place}/pacelake_blocks*")
