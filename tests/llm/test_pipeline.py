"""Each stage of the pipeline against a plain version on the smallest tables."""

import os
import re
from collections import Counter, defaultdict

import pytest

duckdb = pytest.importorskip("duckdb")
import corpus_pipeline  # noqa: E402
from pacelake.llm import mixing, quality_rules  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])


def by_sql(sql, arrow):
    con = duckdb.connect()
    con.register("documents", arrow)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def test_stages_in_turn(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS, name
        path = os.path.join(tmp_path, name)
        out.write.parquet(path)
        kept.append((docs, spark.read.parquet(path)))
        docs = kept[-1][1]

    before, after = kept[0]
    verdict = {r["doc_id"]: r["kept"] for r in by_sql(quality_rules.OP1_SQL, before.toArrow())}
    after_rows = {r["doc_id"]: r for r in rows_of(after)}
    assert set(after_rows) == {i for i, ok in verdict.items() if ok} and len(after_rows) > 50
    source = {r["doc_id"]: r["text"] for r in rows_of(before)}
    for i, r in after_rows.items():
        lines = iter(source[i].split("\n"))
        assert all(line in lines for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"])

    before, after = map(rows_of, kept[1])
    pages, holds = Counter(r["source"] for r in before), Counter((r["source"], x) for r in before for x in {y.strip(" \t\n\x0b\x0c\r") for y in r["text"].split("\n")} if x)
    for a, b in zip(before, after, strict=True):
        left = [x for x in a["text"].split("\n") if not (n := holds[a["source"], x.strip(" \t\n\x0b\x0c\r")]) >= 3 or n <= 0.05 * pages[a["source"]]]
        assert b["text"] == "\n".join(left) and a["doc_id"] == b["doc_id"]

    before, after = map(rows_of, kept[2])
    sets = {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[r["doc_id"]] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert [r["doc_id"] for r in after] == [i for i in sorted(sets) if find(i) == i]

    before, after = kept[3]
    want = Counter({r["doc_id"]: r["copies"] for r in by_sql(mixing.OP2_SQL, before.toArrow()) if r["copies"]})
    assert Counter(r["doc_id"] for r in rows_of(after)) == want

    copies = Counter(r["doc_id"] for r in rows_of(kept[4][0]))
    spans, pieces = defaultdict(list), Counter()
    for r in kept[4][1].collect():
        spans[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.piece == 0
    assert pieces == copies
    for s in spans.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_equals_its_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and "sequence_id" in out.columns
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]


def odd_documents():
    good = "\n".join(f"Line {k} of this text says something of its own about number {k * 7}, and it ends well." for k in range(12))
    other = "\n".join(f"Another story goes on here with word{k} and thing{k * 3}, as stories like this one do." for k in range(12))
    near = good.replace("number 7,", "number eight,")
    rows = [(1, good), (1, other), (2, good), (2, good), (None, good), (None, other), (3, near), (4, None), (5, ""), (6, "x"), (7, good * 40), (7, "\n".join(f"Fresh{k} tale{k} told{k} long{k} ago{k} by{k} them{k}." for k in range(3000)))]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, "extra", 1, "z") for k, (i, t) in enumerate(rows)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int, sequence_id string"


@pytest.mark.parametrize("rows", [odd_documents(), []], ids=["odd", "empty"])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, ODD)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == COLUMNS, name
        path = os.path.join(tmp_path, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if not rows:
            assert docs.count() == 0
    assert not rows or docs.where("piece = 0").count() > 0


def test_near_duplicates_are_told_by_row(spark, tmp_path):
    rows = [r[:5] for r in odd_documents()]
    path = os.path.join(tmp_path, "docs")
    spark.createDataFrame(rows, ", ".join(ODD.split(", ")[:5])).repartition(5).write.parquet(path)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.near(spark, spark.read.parquet(path), "").collect())
    good, other = rows[0][1], rows[1][1]
    assert left == Counter([(1, good), (1, other), (4, None), (5, ""), (6, "x"), rows[11][:2]])
