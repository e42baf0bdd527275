"""Labels, record lines and the memo of an inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.functions import portable as P
from karakuri.plans import dims

NOTHING = "問題項目はありません。"
_SHOWN = {"fr": ("front_rear", {"front": "フロント", "rear": "リヤ"}), "lr": ("left_right", {"left": "左", "right": "右"}), "io": ("inner_outer", {"inner": "インナー", "outer": "アウター"})}


def position_label() -> str:
    """SQL: the axes joined by a middle dot; null without any."""
    parts = ["CASE " + " ".join(f"WHEN {c} = '{v}' THEN '{t}'" for v, t in shown.items()) + " END" for c, shown in _SHOWN.values()]
    return f"nullif(concat_ws('・', {', '.join(parts)}), '')"


def summary_line(readings: str) -> str:
    """SQL: position, measurement, readings and note, joined by slashes; empty without any."""
    return f"concat_ws(' / ', {position_label()}, CASE WHEN value IS NOT NULL THEN concat({P.number_text('value')}, 'mm') END, {readings}, nullif(note, ''))"


def full_label(line: str) -> str:
    return f"concat_ws(' ', category, nullif({line}, ''))"


def status_label(status: str) -> str:
    return f"CASE {status} " + " ".join(f"WHEN '{s}' THEN '{label}'" for s, label, _ in dims.STATUSES) + " END"


def readings_of(measurements: str = "measurements") -> str:
    """Spark SQL: the readings of a map in its order, each with its unit."""
    return f"nullif(array_join(transform(map_entries({measurements}), e -> concat(e.key, ': ', {P.number_text('e.value')}, CASE e.key WHEN 'CO' THEN '%' WHEN 'HC' THEN 'ppm' ELSE '' END)), ' / '), '')"


def labelled(items: DataFrame) -> DataFrame:
    """items with ord and category from the checklist (a left join with the fixed dictionary), line and label. Custom
    items keep their own category, and stand behind the checklist in the order of their own ord."""
    known = F.broadcast(dims.checklist_dim(items.sparkSession).select("item_id", F.col("ord").alias("_ord"), F.col("category").alias("_category")))
    own = F.coalesce(F.col("ord"), F.lit(0)) if "ord" in items.columns else F.lit(0)
    category = F.coalesce("_category", "category") if "category" in items.columns else F.col("_category")
    found = items.join(known, "item_id", "left").withColumns({"ord": F.coalesce("_ord", F.lit(len(dims.CHECKLIST)) + own).cast("int"), "category": category})
    return found.drop("_ord", "_category").withColumn("line", F.expr(summary_line(readings_of()))).withColumn("label", F.expr(full_label("line")))


def memo(inspections: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, memo): a header of what is known of customer, vehicle and mileage; then problem items by status, in order."""
    titles = F.broadcast(dims.status_dim(items.sparkSession).where("summary_ord IS NOT NULL").select("status", "summary_ord", F.col("label").alias("title")))
    grouped = labelled(items).join(titles, "status").groupBy(key, "summary_ord", "title").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("lines"))
    block = F.concat(F.lit("【"), F.col("title"), F.lit("】\n"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("・"), x["label"])), "\n"))
    body = grouped.select(key, F.struct("summary_ord", block.alias("b")).alias("b")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["b"]), "\n\n").alias("body"))
    header = F.expr(header_text())
    return inspections.join(body, key, "left").select(key, F.concat_ws("\n\n", F.nullif(header, F.lit("")), F.coalesce("body", F.lit(NOTHING))).alias("memo"))


def header_text() -> str:
    """SQL: what is known of the inspection, joined by slashes."""
    parts = [("お客様名: ", "customer_name", ""), ("車種: ", "vehicle_model", ""), ("走行距離: ", "mileage", "km")]
    return "concat_ws(' / ', " + ", ".join(f"CASE WHEN {c} <> '' THEN concat('{a}', {c}, '{z}') END" for a, c, z in parts) + ")"


def record_lines() -> str:
    """SQL: category, line if any, and judgement, one to a line."""
    judged = status_label("coalesce(status, 'unset')")
    return f"concat_ws(chr(10), category, nullif(line, ''), concat('判定: ', {judged}))"
