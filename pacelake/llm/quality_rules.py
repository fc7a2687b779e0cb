"""Quality rules, line first: rules judge each line, failing lines go, and documents losing too much go.

A line (between newlines) fails if it has a word and meets any of these rules:

* punctuation: symbols ``#*$%&|<>`` number at least 3 and at least 3 for 10 words; or more than 60 % of
  at least 10 ASCII letters are capitals; or it has under 5 words and its last byte is a letter or digit
  of ASCII or a comma, colon or hyphen (an unfinished fragment)
* navigation: under 8 words and it starts with a navigation phrase that no ASCII letter or digit follows
* boilerplate: it holds a boilerplate phrase (both lists ignore the case of A-Z); with `phrase_words`, only where it
  has under so many words or its phrases hold a tenth of its word characters

A document is rejected by the base rules (too few words, or mostly repeated three-word windows), or if its
failing lines hold more than `max_lost` of all word characters. Null or empty texts have no words and fail
the base rules; a null id is carried through; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Fixed values.
NAVIGATION = ("home", "menu", "next", "previous", "login", "log in", "sign in", "sign up", "subscribe", "read more", "share this", "skip to", "back to top", "search")
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "enable javascript", "click here", "lorem ipsum")
SYMBOLS = b"#*$%&|<>"

_NAV = re.compile(b"(?:" + b"|".join(x.encode() for x in NAVIGATION) + b")(?![0-9A-Za-z])", re.I)
_BOILER = re.compile(b"|".join(x.encode() for x in BOILERPLATE), re.I)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER, _LOWER = (np.zeros(256, bool) for _ in range(2))
_UPPER[65:91] = _LOWER[97:123] = True
_OPEN_END = np.zeros(256, bool)
_OPEN_END[[*range(48, 58), *range(65, 91), *range(97, 123), *b",:-"]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_failed long, lost_chars long"


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; a text of k newlines has k + 1 lines."""
    newline = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], newline + 1]))
    rows = np.repeat(np.arange(len(at) - 1), np.bincount(tx.rows_of(at, newline), minlength=len(at) - 1) + 1)
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends = np.append(starts[1:], 0) - 1
    ends[last] = at[rows[last] + 1]
    return starts, ends, rows


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _repeats(data: np.ndarray, ls: np.ndarray, le: np.ndarray, lrow: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Lines of `used` that are equal to an earlier one of their text: told by hash, then byte by byte."""
    out = np.zeros(len(ls), bool)
    key = tx.range_hashes(data, ls[used], le[used])
    order = np.lexsort((used, key, lrow[used]))
    line, key = used[order], key[order]
    before, after = line[:-1], line[1:]
    met = (key[1:] == key[:-1]) & (lrow[before] == lrow[after])
    before, after = before[met], after[met]
    size = le[after] - ls[after]
    alike = size == le[before] - ls[before]
    if alike.all() and tx.same_ranges(data, ls[before], ls[after], size).all():
        out[after] = True
        return out
    seen = set()  # two different lines have one hash: all are told by their bytes
    for i in used.tolist():
        body = (int(lrow[i]), data[ls[i] : le[i]].tobytes())
        out[i] = body in seen
        seen.add(body)
    return out


def judge(data: np.ndarray, at: np.ndarray, min_words: int, max_lost: float, phrase_words: int | None = None) -> tuple[dict[str, np.ndarray], tuple]:
    """The figures of each text of a block, and its lines with the verdict on each."""
    n = len(at) - 1
    ws, we, wrow = tx.words(data, at)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEAD[data] & ~tx.SPACE[data], out=inside[1:])
    n_words = np.bincount(wrow, minlength=n)
    repeated = np.zeros(len(ws), bool)
    if len(ws) > 2:
        ids, distinct = tx.word_ids(data, ws, we)
        whole = np.flatnonzero(wrow[2:] == wrow[:-2])
        head, rest = ids[whole] * distinct + ids[whole + 1], wrow[whole] * distinct + ids[whole + 2]  # words themselves, no hashes
        order = np.lexsort((rest, head))
        same = (head[order][1:] == head[order][:-1]) & (rest[order][1:] == rest[order][:-1])
        again = np.zeros(len(whole), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        first = whole[again]
        for k in range(3):
            repeated[first + k] = True

    ls, le, lrow = _lines(data, at)
    lo, hi = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    per_line = hi - lo
    chars = inside[le] - inside[ls]
    duplicate = _repeats(data, ls, le, lrow, np.flatnonzero(per_line > 0))

    symbols = _IS_SYMBOL[data]
    s, up, low = (_count(x, ls, le) for x in (symbols, _UPPER[data], _LOWER[data]))
    ending = np.zeros(len(ls), bool)
    full = le > ls
    ending[full] = _OPEN_END[data[le[full] - 1]]
    failed = (s >= 3) & (10 * s >= 3 * per_line) | (up + low >= 10) & (10 * up > 6 * (up + low)) | (per_line < 5) & ending
    raw = data.tobytes()
    for i in np.flatnonzero(~failed & (per_line < 8) & (per_line > 0)):
        failed[i] = _NAV.match(raw, ws[lo[i]], le[i]) is not None
    held = np.zeros(len(ls), np.int64)
    for m in _BOILER.finditer(raw):
        i = np.searchsorted(ls, m.start(), side="right") - 1
        if m.end() <= le[i]:
            held[i] += inside[m.end()] - inside[m.start()]
    failed |= (held > 0) & (True if phrase_words is None else (per_line < phrase_words) | (10 * held >= chars))
    failed &= per_line > 0

    all_chars = np.bincount(lrow, chars, n).astype(np.int64)
    lost = np.bincount(lrow[failed], chars[failed], n).astype(np.int64)
    n_repeat = np.bincount(wrow[repeated], minlength=n)
    base_failed = (n_words < min_words) | (100 * n_repeat > 50 * n_words)
    out = {
        "n_words": n_words, "word_chars": all_chars, "n_symbols": tx.per_row(symbols, at), "n_dup_lines": np.bincount(lrow[duplicate], minlength=n),
        "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~base_failed & (lost <= max_lost * all_chars),
        "n_lines": np.bincount(lrow[per_line > 0], minlength=n), "n_lines_failed": np.bincount(lrow[failed], minlength=n), "lost_chars": lost,
    }
    return out, (ls, le, lrow, failed)


def clean_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, max_lost: float = 0.5, carry: tuple[str, ...] = (), with_text: bool = False, phrase_words: int | None = None) -> DataFrame:
    """One row for each of `docs`: the figures and verdict, `carry` columns as they are, and with `with_text` the `clean_text` left of each."""
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry]]
    kinds = dict(docs.dtypes)
    schema = FIELDS + ", clean_text string" * with_text + "".join(f", `_carry_{c}` {kinds[c]}" for c in carry)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for i, j, data, at in tx.blocks(texts):
                figures, (ls, le, lrow, failed) = judge(data, at, min_words, max_lost, phrase_words)
                cells = {"doc_id": batch.column(0).slice(i, j - i)} | {k: pa.array(v, pa.bool_() if v.dtype == bool else pa.int64()) for k, v in figures.items()}
                if with_text:
                    raw, left = data.tobytes(), [[] for _ in range(j - i)]
                    for k in np.flatnonzero(~failed):
                        left[lrow[k]].append(raw[ls[k] : le[k]])
                    cells["clean_text"] = pa.array([b"\n".join(x).decode() for x in left], pa.string())
                cells |= {f"_carry_{c}": batch.column(2 + k).slice(i, j - i) for k, c in enumerate(carry)}
                yield pa.RecordBatch.from_pydict(cells)

    out = docs.select(*cols).mapInArrow(run, schema)
    return out.select(*[c for c in out.columns if not c.startswith("_carry_")], *[F.col(f"_carry_{c}").alias(c) for c in carry])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_W = r"[^\x20\x09-\x0D]+"
_ALT = "|".join
OP1_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from (select doc_id, regexp_extract_all(text, '{_W}') as ws from d) x),
g as (select *, lead(w, 1) over o as w1, lead(w, 2) over o as w2 from w window o as (partition by doc_id order by i)),
c as (select doc_id, i, count(*) over (partition by doc_id, w, w1, w2) as n from g where w2 is not null),
r as (select doc_id, count(distinct i) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as i from c where n > 1) x group by doc_id),
b as (select doc_id, count(*) as n_words from w group by doc_id),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from (select doc_id, string_split(text, chr(10)) as ls from d) x),
m as (select doc_id, i, line, len(regexp_extract_all(line, '{_W}')) as n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as s, length(regexp_replace(line, '[^A-Z]', '', 'g')) as up, length(regexp_replace(line, '[^a-z]', '', 'g')) as low,
  row_number() over (partition by doc_id, line order by i) as nth from l),
f as (select *, n > 0 and ((s >= 3 and 10 * s >= 3 * n) or (up + low >= 10 and 10 * up > 6 * (up + low)) or (n < 5 and regexp_matches(line, '[0-9A-Za-z,:-]$'))
  or (n < 8 and regexp_matches(line, '^[\x20\x09-\x0D]*({_ALT(NAVIGATION)})([^0-9A-Za-z]|$)', 'i')) or regexp_matches(line, '({_ALT(BOILERPLATE)})', 'i')) as failed from m),
t as (select doc_id, sum(chars) as word_chars, sum(s) as n_symbols, count(*) filter (where n > 0 and nth > 1) as n_dup_lines, count(*) filter (where n > 0) as n_lines,
  count(*) filter (where failed) as n_lines_failed, coalesce(sum(chars) filter (where failed), 0) as lost_chars from f group by doc_id),
a as (select t.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(n_lines as bigint) as n_lines, cast(n_lines_failed as bigint) as n_lines_failed, cast(lost_chars as bigint) as lost_chars
  from t left join b on t.doc_id = b.doc_id left join r on t.doc_id = r.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * lost_chars <= word_chars as kept, n_lines, n_lines_failed, lost_chars from a
"""
QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": OP1_SQL}
