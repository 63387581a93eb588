"""Line deduplication by distinct-site spread.

Each line's sites are counted by a HyperLogLog sketch that merges in partial aggregation. A sketch's count can be off by a few
per cent, so lines whose estimate is near the threshold get their exact distinct count; the result equals that of exact counts.
A line on at least `min_sites` sites is boilerplate: its first occurrence (smallest id, then place) stays, the others go.

Lines are split at line feeds and compared without the spaces around them, by 128 bits of hash; lines of spaces alone stay.

Everything runs as DataFrame operations. Counting is partial; the joins have one row a line (or a document) on one side, so that
Spark can split a very common line. Texts move once, to meet the list of their removed lines.

Cases: a null text stays null with no lines; a null site is no site; a null id comes after every other; rows with the same id
and text are one document for counting, and are changed alike; a text of very many lines takes time in proportion to them, and its lines
are spread over tasks like all others, but it is put together in one; an empty table gives an empty table; other columns, whatever
their names, are carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut, row_key

#: log2 of the buckets of a sketch, and its relative standard error times six: beyond it an estimate is taken as certain.
LG_K = 12
MARGIN = 6 * 1.04 / 2 ** (LG_K / 2)


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    k1, k2 = row_key(id_col, text_col)
    text, site = F.col(f"`{text_col}`"), F.col(f"`{site_col}`")
    # keys first: beside posexplode they would be computed for every line
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{id_col}`").alias("id"), site.alias("site"), F.split(text, "\n").alias("parts"))
    each = keyed.select("k1", "k2", "id", "site", F.posexplode("parts").alias("pos", "line"))
    line = F.trim("line")
    return each.select("k1", "k2", "id", "site", "pos", line.alias("line")).where("line <> ''").select("k1", "k2", "id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2 and the first place of each line that is on at least min_sites sites."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "pos")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"), F.min(order).alias("first"))
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    some = sketched.where(F.col("estimate") >= low)
    near = some.where(F.col("estimate") <= high).select("h1", "h2")
    # distinct pairs first: a line has at most as many rows as sites from then on
    exact = lines.select("h1", "h2", "site").distinct().join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("site").alias("sites"))
    return some.join(exact, ["h1", "h2"], "left").where((F.col("estimate") > high) | (F.col("sites") >= min_sites)).select("h1", "h2", "first")


def _marked(docs: DataFrame, min_sites: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """docs, with columns c0 and so on, and n_lines, n_removed and kept."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread_lines = cut(spread(lines, min_sites))  # apart from the join, whose hot lines Spark can split then
    here = F.struct("k1", "k2", "pos")
    first = F.struct(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), F.col("first.pos").alias("pos"))
    removed = lines.join(spread_lines, ["h1", "h2"]).where(here != first).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    k1, k2 = row_key(id_col, text_col)
    joined = docs.select(k1.alias("k1"), k2.alias("k2"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).join(removed, ["k1", "k2"], "left")
    text = F.col(f"c{docs.columns.index(text_col)}")
    parts = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")  # by hashing, in order
    # the array of one array gives the lines a name, so that they are split once
    kept = F.transform(F.array(parts), lambda some: F.array_join(F.transform(places, lambda i: some[i]), "\n"))[0]
    n_lines, n_removed = F.coalesce(F.size(parts).cast("long"), F.lit(0)), F.coalesce(F.size("gone").cast("long"), F.lit(0))
    return joined.select("*", n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.when(F.col("gone").isNull(), text).otherwise(kept).alias("kept"))


def mark_lines(docs: DataFrame, min_sites: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with n_lines, n_removed and kept_text (null for a null text); columns of docs with these names are replaced."""
    marked = _marked(docs, min_sites, id_col, text_col, site_col)
    carried = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed", "kept_text")]
    return marked.select(*carried, "n_lines", "n_removed", F.col("kept").alias("kept_text"))


def dedup_lines(docs: DataFrame, min_sites: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with their boilerplate lines taken out; a document of which only blank lines are left goes."""
    marked = _marked(docs, min_sites, id_col, text_col, site_col)
    stays = (F.col("n_removed") == 0) | F.col("kept").rlike(r"[^ \n]")
    return marked.where(stays).select(*((F.col("kept") if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def oracle(min_sites: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, source, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM d),
s AS (SELECT trim(part, ' ') AS line, count(DISTINCT source) AS sites, min((doc_id, pos)) AS first FROM l GROUP BY 1 HAVING trim(part, ' ') <> '' AND count(DISTINCT source) >= {min_sites}),
k AS (SELECT doc_id, count(*) FILTER (WHERE s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first) AS n_removed,
        string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE s.line IS NULL OR (l.doc_id, l.pos) = s.first) AS kept
      FROM l LEFT JOIN s ON trim(l.part, ' ') = s.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
