"""Cross-site line dedup by distinct-site spread (operator 10).

A line that stands on many sites is boilerplate: licence lines, menus, footers. For each line hash, a
HyperLogLog sketch of its sites is built by partial aggregation and merged. The estimate settles the
lines that are clearly under or over the threshold; for those near it, the sites are counted exactly.
Of each boilerplate line the first copy (smallest id, then first in its text) stays, so that no text
is lost from the corpus; all others go.

Lines that are rarer than the threshold can't reach it and get no sketch: a line has at most as many
sites as copies.

Edge cases: lines are compared without the white space at their ends; lines of white space only are
never boilerplate; a null text has no lines and stays null; a null site counts as no site; rows that
repeat an id with an equal text are treated alike; of rows without id the first copies come last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_frequent, text_of

#: Sketches have 2^LG registers; their relative standard error is about 1.04 / sqrt(2^LG).
LG = 12


def _keyed(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("body"), F.col(site_col).cast("string").alias("site"), text_of(text_col).alias("text"))


def _stripped(line):
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _lines(keyed: DataFrame) -> DataFrame:
    """(id, body, site, at, line): a 128-bit hash of every line with a word; at counts lines from 0."""
    lines = keyed.select("id", "body", "site", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("raw", _stripped("raw")).where("raw <> ''")
    return lines.select("id", "body", "site", "at", F.struct(F.xxhash64("raw").alias("h"), F.xxhash64(F.reverse("raw"), F.length("raw")).alias("g")).alias("line"))


def boilerplate(lines: DataFrame, least_sites: int) -> DataFrame:
    """(line, first): line hashes that stand on `least_sites` sites or more; first: place of the copy that stays."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "body", "at"))
    often = cut(lines.groupBy("line").agg(F.count("*").alias("copies"), first.alias("first")).where(F.col("copies") >= least_sites).select("line", "first"))
    sites = cut(join_frequent(lines.select("line", "site"), often.select("line"), "line").where("site is not null"))
    sketches = sites.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG)).alias("spread"))
    spread = cut(sketches)
    margin = max(1.0, 4 * 1.04 / 2 ** (LG / 2) * least_sites)
    near = spread.where(F.abs(F.col("spread") - least_sites) <= margin).select("line")
    exact = join_frequent(sites, near, "line").distinct().groupBy("line").count().where(F.col("count") >= least_sites).select("line")
    return often.join(spread.where(F.col("spread") > least_sites + margin).select("line").union(exact), "line", "left_semi")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = 8) -> DataFrame:
    """(id, body, gone): for each document that loses lines, their numbers; body is the text's hash."""
    lines = cut(_lines(_keyed(docs, id_col, text_col, site_col)))
    hits = join_frequent(lines, cut(boilerplate(lines, least_sites)), "line")
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("body") == F.col("first.body")) & (F.col("at") == F.col("first.at")))
    return hits.where(later).groupBy("id", "body").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = 8, length_col: str | None = None) -> DataFrame:
    """`docs` with boilerplate lines taken out of its texts; all rows stay, emptied texts are ''.

    `length_col`, if given, is set to the code points of the new text where lines went.
    """
    gone = removals(docs, id_col, text_col, site_col, least_sites).select(F.col("id").alias("\x01id"), F.col("body").alias("\x01body"), F.col("gone").alias("\x01gone"))
    rows = docs.join(gone, F.col(id_col).eqNullSafe(F.col("\x01id")) & (F.xxhash64(text_of(text_col)) == F.col("\x01body")), "left")
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda _, k: ~F.array_contains("\x01gone", k)), "\n")
    text = F.when(F.col("\x01gone").isNull(), F.col(text_col)).otherwise(left)
    out = {text_col: text}
    if length_col:
        out[length_col] = F.when(F.col("\x01gone").isNull(), F.col(length_col)).otherwise(F.length(left).cast(docs.schema[length_col].dataType))
    return rows.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = 8) -> DataFrame:
    """One row for each row of `docs`: id_col, n_lines, n_removed, removed (line numbers)."""
    gone = removals(docs, id_col, text_col, site_col, least_sites).withColumnsRenamed({"id": "\x01id", "body": "\x01body"})
    rows = docs.select(id_col, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).cast("long").alias("n_lines"), F.xxhash64(text_of(text_col)).alias("\x02body"))
    found = rows.join(gone, F.col(id_col).eqNullSafe(F.col("\x01id")) & (F.col("\x02body") == F.col("\x01body")), "left")
    return found.select(id_col, "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))
