"""Site-relative line dedup: lines on too large a part of a host's pages are boilerplate and go.

For each host, the pages holding a line (whatever its place, compared without ASCII white space around it) are
divided by the host's pages; lines with `min_pages` pages or more whose part exceeds `ratio` are dropped from
all of them. Lines travel as 128-bit hashes. Blank lines are never judged. Null text stays null and has no
lines; pages without a host are left alone. Each row counts as a page and is cleaned for itself, repeated rows and
rows with equal or null ids too: the input is written once with a number for each row, which its lines carry. All
columns pass through whatever their names; a column named `line_dedup` gives way to the result. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: HTML elements that begin or end a line.
BLOCKS = "br|p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h1|h2|h3|h4|h5|h6|tr|td|th|table|title|pre|blockquote|form"
SPACES = " \t\n\x0b\x0c\r"
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def host_of(url):
    """Lower-case host of an http(s) URL, without port or user; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def lines_of_html(html):
    """Text lines of a page: block elements break lines, scripts, styles, comments and other tags go."""
    bare = F.regexp_replace(html, r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)", "")
    return F.regexp_replace(F.regexp_replace(bare, rf"<(?i:/?(?:{BLOCKS}))(?:\s[^>]*+)?/?>", "\n"), r"<[^>]*+>", "")


def _keys(lines):
    """128-bit hash of each line, null for blank ones."""

    def key(line):
        bare = F.btrim(line, F.lit(SPACES))
        return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))

    return F.transform(lines, key)


def boilerplate_lines(keyed: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(h, k) of lines to drop, from (h, keys). Counts combine before the shuffle; a host gives at most lines-a-page / ratio of them."""
    counts = keyed.select("h", F.explode(F.array_compact(F.array_distinct("keys"))).alias("k")).groupBy("h", "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = keyed.groupBy(F.col("h").alias("h2")).agg(F.count("*").alias("total"))
    return counts.join(totals, F.col("h") == F.col("h2")).where(F.col("n") > ratio * F.col("total")).select("h", "k")


def _without(lines, places):
    """`lines` joined again without those at `places` (in order, from 0): the stretches between them, each copied once."""
    one = F.array(F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines))).alias("ends")))  # worked out once
    between = lambda x, j: F.slice(x["lines"], x["ends"][j] + 2, x["ends"][j + 1] - x["ends"][j] - 1)
    return F.array_join(F.flatten(F.transform(one, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["ends"]) - 2), lambda j: between(x, j))))), "\n")


def dedup_lines(pages: DataFrame, host: str, text: str, ratio: float = 0.25, min_pages: int = 3) -> DataFrame:
    """`pages` with a struct `line_dedup` of the cleaned text, n_lines and n_dropped."""
    names = [c for c in pages.columns if c != "line_dedup"]
    rows = tx.stored(pages.select(F.monotonically_increasing_id().alias("row"), F.struct(*[pages[c] for c in names]).alias("page")))
    h, t = F.col("page")[host], F.col("page")[text]
    keyed = rows.where(h.isNotNull() & t.isNotNull()).select("row", h.alias("h"), _keys(F.split(t, "\n")).alias("keys"))
    bad = boilerplate_lines(keyed, ratio, min_pages).select(F.col("h").alias("bad_h"), F.col("k").alias("bad_k"))
    lines = keyed.select("row", "h", F.posexplode("keys").alias("place", "k")).where(F.col("k").isNotNull())
    hits = lines.join(bad, (F.col("h") == F.col("bad_h")) & (F.col("k") == F.col("bad_k"))).groupBy(F.col("row").alias("hit_row")).agg(F.array_sort(F.collect_list("place")).alias("places"))
    joined = rows.join(hits, F.col("row") == F.col("hit_row"), "left")
    n_lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    found = F.struct(
        F.when(F.col("places").isNull(), t).otherwise(_without(F.split(t, "\n"), F.col("places"))).alias("text"),
        F.when(t.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return joined.select("page", found.alias("found")).select(*[F.col("page")[c].alias(c) for c in names], F.col("found").alias("line_dedup"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), lines_of_html(F.col("html")).alias("text"))
    out = dedup_lines(pages, "host", "text")
    return out.select("page_id", "host", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.text", 256).alias("kept_sha256"))


OP8_SQL = rf"""
with p as (select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') as host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') as text from pages),
l as (select page_id, host, unnest(ls) as line, unnest(range(len(ls))) as i from (select page_id, host, string_split(text, chr(10)) as ls from p) x),
k as (select *, nullif(regexp_replace(line, '{TRIM}', '', 'g'), '') as k from l),
n as (select host, k, count(distinct page_id) as n from k where k is not null and host is not null group by host, k),
t as (select host, count(*) as total from p group by host),
b as (select n.host, n.k from n join t on n.host = t.host where n.n >= 3 and n.n > 0.25 * t.total),
m as (select k.*, b.k is not null as bad from k left join b on k.host = b.host and k.k = b.k)
select p.page_id, p.host, cast(count(m.k) as bigint) as n_lines, cast(count(m.k) filter (where m.bad) as bigint) as n_dropped,
  case when p.text is null then null else sha256(coalesce(string_agg(m.line, chr(10) order by m.i) filter (where not m.bad), '')) end as kept_sha256
from p left join m on p.page_id = m.page_id group by p.page_id, p.host, p.text
"""
QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": OP8_SQL}
