"""Checklist items in folded text: exact and fuzzy aliases by a pigeonhole equi-join, then greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karakuri.plans import dims

TOKEN = "start int, `end` int, item_id string, alias string, match_type string"


def hamming(a: Column, b: Column) -> Column:
    """Characters that differ between strings of one length; the longer length for strings of two."""
    differing = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))))
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).when(F.length(a) == 0, F.lit(0)).otherwise(differing)


def pieces(aliases=dims.ALIASES) -> list[tuple[int, int, int, str, int, str, str, int]]:
    """(n, offset, length, piece, rank, item, alias, d): each alias in d + 1 pieces; what differs from it in d
    characters at most holds one of them in its place."""
    out = []
    for rank, item, alias, n in aliases:
        d = dims.fuzzy_limit(n)
        cuts = [n * k // (d + 1) for k in range(d + 2)]
        out += [(n, a, b - a, alias[a:b], rank, item, alias, d) for a, b in zip(cuts, cuts[1:])]
    return out


def tokens_of(texts: DataFrame, column: str = "compare", aliases=dims.ALIASES) -> DataFrame:
    """Distinct folded texts -> (column, tokens): the tokens in order, not overlapping; empty where there are none.

    At each place the longest alias that starts there counts, else the alias that differs in few characters, if all
    such aliases name one item. From the left, each token hides what starts inside it.
    """
    spark = texts.sparkSession
    table = pieces(aliases)
    lengths = F.array(*[F.lit(m) for m in sorted({r[2] for r in table})])
    known = F.broadcast(spark.createDataFrame(table, "n int, o int, m int, piece string, rank int, item_id string, alias string, d int"))  # a fixed dictionary
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: short texts make many places, so their bytes are no measure
    distinct = texts.select(column).where(F.col(column).isNotNull()).distinct().repartition(parts, column)
    at = distinct.where(F.length(column) > 0).select(column, F.explode(F.sequence(F.lit(0), F.length(column) - 1)).alias("p"))
    near = (
        at.select(column, "p", F.explode(lengths).alias("m"))
        .where(F.col("p") + F.col("m") <= F.length(column))
        .select(column, "p", F.substring(F.col(column), F.col("p") + 1, F.col("m")).alias("piece"))
        .join(known, "piece")
        .withColumn("start", F.col("p") - F.col("o"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.length(column)))
        .select(column, "start", "n", "rank", "item_id", "alias", "d", hamming(F.substring(F.col(column), F.col("start") + 1, F.col("n")), F.col("alias")).alias("off"))
        .where(F.col("off") <= F.col("d"))
    )
    entry = F.struct("rank", "item_id", "alias", "n")
    exact, fuzzy = F.col("off") == 0, F.col("off") > 0
    best = near.groupBy(column, "start").agg(
        F.min(F.when(exact, entry)).alias("e"), F.min(F.when(fuzzy, entry)).alias("f"),
        F.min(F.when(fuzzy, F.col("item_id"))).alias("low"), F.max(F.when(fuzzy, F.col("item_id"))).alias("high"),
    )
    chosen = F.coalesce("e", F.when(F.col("low") == F.col("high"), F.col("f")))
    found = best.select(column, "start", chosen.alias("t"), F.when(F.col("e").isNotNull(), "exact").otherwise("fuzzy").alias("match_type")).where("t IS NOT NULL")
    token = F.struct("start", (F.col("start") + F.col("t.n")).alias("end"), F.col("t.item_id").alias("item_id"), F.col("t.alias").alias("alias"), "match_type")
    listed = found.groupBy(column).agg(F.array_sort(F.collect_list(token)).alias("all"))
    empty = F.expr(f"cast(array() AS array<struct<{TOKEN.replace(' ', ':').replace(',:', ', ')}>>)")
    greedy = F.aggregate("all", empty, lambda acc, t: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= t["start"]), F.concat(acc, F.array(t))).otherwise(acc))
    return distinct.join(listed.select(column, greedy.alias("tokens")), column, "left").select(column, F.coalesce("tokens", empty).alias("tokens"))


def merged(tokens: Column) -> Column:
    """Of neighbouring tokens of one item only the first."""
    return F.filter(tokens, lambda t, k: (k == 0) | (t["item_id"] != F.get(tokens, F.greatest(k - 1, F.lit(0)))["item_id"]))


def exact_items(compare: Column, aliases=dims.ALIASES) -> Column:
    """The aliases in a text, greedily from the left, without fuzzy matching: one pass of a regular expression."""
    return F.regexp_extract_all(compare, F.lit("(" + "|".join(a for _, _, a, _ in aliases) + ")"))


def approx_match(candidate: Column, aliases=dims.ALIASES) -> Column:
    """(d, rank, item_id) of the one item nearest to a whole segment within the limits of edits; null if none or a tie."""
    entries = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(i).alias("item_id"), F.lit(a).alias("alias"), F.lit(dims.approx_limit(n)).alias("most")) for r, i, a, n in aliases if dims.approx_limit(n)])
    scored = F.transform(entries, lambda e: F.struct(F.when(F.abs(F.length(candidate) - F.length(e["alias"])) <= e["most"], F.levenshtein(candidate, e["alias"], 3)).alias("d"), e["rank"].alias("rank"), e["item_id"].alias("item_id"), e["most"].alias("most")))
    near = F.filter(scored, lambda x: (x["d"] > 0) & (x["d"] <= x["most"]))
    return F.transform(F.array(near), lambda v: F.when(F.size(F.filter(v, lambda x: (x["d"] == F.array_min(v)["d"]) & (x["item_id"] != F.array_min(v)["item_id"]))) == 0, F.array_min(v)))[0]
