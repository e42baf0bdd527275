"""The document store: one JSON array of inspections, and its operations as relational ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karakuri.plans import dims

ITEM = "id string, category string, status string, note string, position struct<frontRear: string, leftRight: string, innerOuter: string>, measurement struct<value: double, unit: string>, measurements map<string, double>, isCustom boolean, updatedAt string"


def _typed(fields: str) -> str:
    """`a string, b int` as `a: string, b: int`, nested types left as they are."""
    out, depth, now = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = now.strip().partition(" ")
            out.append(f"{name}: {kind}")
            now = ""
        else:
            now += c
    return ", ".join(out)


INSPECTION = f"id string, customerName string, vehicleModel string, mileage string, createdAt string, updatedAt string, items array<struct<{_typed(ITEM)}>>"


def scan(stored: DataFrame, value: str = "value", schema: str = INSPECTION) -> DataFrame:
    """Texts that hold a JSON array -> its documents, with store_ord; nothing for what isn't JSON or isn't an array."""
    listed = F.when(F.col(value).rlike(r"^[ \t\r\n]*\["), F.from_json(value, f"array<struct<{_typed(schema)}>>"))
    keys = [c for c in stored.columns if c != value]
    return stored.select(*keys, F.posexplode(F.coalesce(listed, F.array())).alias("store_ord", "doc")).where("doc IS NOT NULL").select(*keys, "store_ord", "doc.*")


def document(columns: list[str]) -> Column:
    """A row as JSON; absent values are left out."""
    return F.to_json(F.struct(*columns))


def arrays(store: DataFrame, columns: list[str], *keys: str, order: str = "store_ord") -> DataFrame:
    """(keys, value): each stored list written back whole, as one JSON array in the order of the store."""
    held = store.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, document(columns).alias("doc")))).alias("docs"))
    return held.select(*keys, F.concat(F.lit("["), F.array_join(F.transform("docs", lambda d: d["doc"]), ","), F.lit("]")).alias("value"))


def listing(store: DataFrame, updated: str = "updated_at") -> DataFrame:
    """Newest first; equal times stay in the order of the store."""
    return store.orderBy(F.desc(updated), F.asc("store_ord"))


def get(store: DataFrame, key: str, wanted) -> DataFrame:
    """The first document of one id."""
    return store.where(F.col(key) == wanted).orderBy("store_ord").limit(1)


def upsert(store: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Documents replaced in their place by id (only the first of equal ids), new ones behind the last. Of an id that
    changed more than once the last value counts, in the first one's place. No single task sees the whole store: a full
    join by id, new places counted from the highest."""
    rest = [c for c in store.columns if c not in (key, "store_ord")]
    latest = changed.groupBy(key).agg(F.min("store_ord").alias("store_ord"), F.max_by(F.struct(*rest), "store_ord").alias("_v"))
    changed = latest.select(key, "store_ord", "_v.*")
    first = store.groupBy(key).agg(F.min("store_ord").alias("store_ord")).withColumn("_first", F.lit(True))
    marked = store.join(first, [key, "store_ord"], "left")
    new = changed.select(key, F.struct(*rest).alias("_new"))
    replaced = marked.join(new, key, "left").select(key, "store_ord", *[F.when(F.col("_first") & F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rest])
    top = store.agg(F.coalesce(F.max("store_ord"), F.lit(-1)).alias("m")).scalar()
    added = changed.join(store.select(key).distinct(), key, "left_anti").select(key, (top + 1 + F.col("store_ord")).alias("store_ord"), *rest)
    return replaced.unionByName(added)


def delete(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """All documents whose id isn't among the given ones."""
    return store.join(gone.select(key).distinct(), key, "left_anti")


def mileage(raw: Column) -> Column:
    """Its ASCII digits; null without any."""
    return F.nullif(F.regexp_replace(raw, "[^0-9]", ""), F.lit(""))


def trimmed(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(raw, f"^[{dims.WHITE}]+", ""), f"[{dims.WHITE}]+$", ""), F.lit(""))


def new_id(millis: Column, seed: Column, prefix: str = "") -> Column:
    """Milliseconds and six letters that follow from the seed, so that a retry makes the same id."""
    return F.concat(F.lit(prefix), millis.cast("string"), F.lit("_"), F.substring(F.md5(seed.cast("string")), 1, 6))


def create(asked: DataFrame, millis: str, seed: str) -> DataFrame:
    """(seed, id, customer_name, vehicle_model, mileage, created_at, updated_at) of new inspections, from (seed, name, model, mileage)."""
    now = iso_time(F.col(millis))
    return asked.select(seed, new_id(F.col(millis), F.col(seed)).alias("id"), trimmed(F.col("name")).alias("customer_name"), trimmed(F.col("model")).alias("vehicle_model"), mileage(F.coalesce("mileage", F.lit(""))).alias("mileage"), now.alias("created_at"), now.alias("updated_at"))


def iso_time(millis: Column) -> Column:
    """Milliseconds as the UTC time that a store holds."""
    day, rest = F.floor(millis / 86_400_000).cast("int"), F.pmod(millis, F.lit(86_400_000))
    part = lambda of, most, n: F.lpad(F.pmod(F.floor(rest / of), F.lit(most)).cast("string"), n, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def create_saved(store: DataFrame, asked: DataFrame, millis: str, seed: str) -> DataFrame:
    """The store with the new inspections behind its last document, each with every checklist item unset."""
    made = create(asked, millis, seed)
    items = default_items(made, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "item_id", "category", "status"))).alias("items"))
    new = made.join(items, "id").select("id", F.col(seed).cast("long").alias("store_ord"), *[c for c in store.columns if c not in ("id", "store_ord")])
    return upsert(store, new, "id")


def default_items(inspections: DataFrame, *keys: str) -> DataFrame:
    """Every checklist item, unset, for each inspection."""
    items = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(item).alias("item_id"), F.lit(name).alias("category"), F.lit("unset").alias("status")) for k, (_, item, name, _) in enumerate(dims.CHECKLIST)])
    return inspections.select(*keys, F.explode(items).alias("_item")).select(*keys, "_item.*")


POSITION = "struct<front_rear: string, left_right: string, inner_outer: string>"
#: What an item holds besides its key, place and id.
HELD = {"category": "string", "status": "string", "note": "string", "position": POSITION, "measurement": "struct<value: double, unit: string>", "measurements": "map<string, double>", "updated_at": "string"}


def reconcile(items: DataFrame, key: str) -> DataFrame:
    """Stored items (key, ord, item_id, and what HELD names) brought in line with the checklist, whole, and is_custom.

    Of equal ids the last value counts, in the first one's place. Checklist items keep what is recorded and get today's
    category; missing ones are unset. Other items stay behind them as custom ones if anything is recorded in them: a
    status, a note, or a position, measurement or readings, even empty ones. Columns of HELD that items lack are null.
    """
    whole = [F.col(c) if c in items.columns else F.lit(None).cast(kind).alias(c) for c, kind in HELD.items()]
    last = F.max_by(F.struct(*whole), "ord")
    stored = items.groupBy(key, "item_id").agg(F.min("ord").alias("first_ord"), last.alias("v"))
    kept = [F.col(f"v.{c}").alias(c) for c in HELD if c not in ("category", "status")]
    listed = default_items(items.select(key).distinct(), key).withColumnsRenamed({"status": "unset", "category": "now"})
    known = listed.join(stored, [key, "item_id"], "left").select(key, "ord", "item_id", F.col("now").alias("category"), F.coalesce("v.status", "unset").alias("status"), *kept, F.lit(False).alias("is_custom"))
    ids = F.broadcast(dims.checklist_dim(items.sparkSession).select("item_id"))
    recorded = (F.col("v.status") != "unset") | (F.coalesce("v.note", F.lit("")) != "") | F.col("v.position").isNotNull() | F.col("v.measurement").isNotNull() | F.col("v.measurements").isNotNull()
    others = stored.join(ids, "item_id", "left_anti").where(recorded)
    place = (F.col("first_ord") + len(dims.CHECKLIST)).cast("int").alias("ord")
    return known.unionByName(others.select(key, place, "item_id", "v.category", "v.status", *kept, F.lit(True).alias("is_custom")))


def get_reconciled(store: DataFrame, items: DataFrame, key: str, wanted) -> DataFrame:
    """The items (store_ord, ord, item_id, ...) of the first document of one id, brought in line with the checklist."""
    return reconcile(items.join(get(store, key, wanted).select(key, "store_ord"), "store_ord").drop("store_ord"), key)


def titled(store: DataFrame) -> DataFrame:
    """store with its title (of list and page): customer, vehicle and mileage, and what stands for a missing customer."""
    name = F.coalesce(F.nullif("customer_name", F.lit("")), F.lit("お客様名未入力"))
    more = lambda c, unit="": F.when(F.col(c) != "", F.concat(F.col(c), F.lit(unit)))
    return store.withColumns({"list_title": F.concat_ws(" / ", name, more("vehicle_model")), "page_title": F.concat_ws(" / ", name, more("vehicle_model"), more("mileage", "km"))})


def edited(items: DataFrame, edits: DataFrame, *keys: str) -> DataFrame:
    """Manual edits: status, position, value and note of an item are replaced whole, readings stay; the unit is mm."""
    replaced = ["status", "front_rear", "left_right", "inner_outer", "value", "note"]
    new = edits.select(*keys, F.struct(*replaced).alias("_new"))
    return items.join(new, list(keys), "left").select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in items.columns])


def delete_custom(items: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Items less those named, of which only custom ones can go."""
    named = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return items.join(named, list(keys), "left").where(~(F.coalesce("_gone", F.lit(False)) & F.coalesce("is_custom", F.lit(False)))).drop("_gone")


def typed_value(raw: Column) -> Column:
    """A number typed into a form; null if it is blank or no number."""
    return trimmed(raw).try_cast("double")
