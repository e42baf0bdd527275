"""Records in order folded into one row for each inspection and item, the queue of unmatched names, and displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karakuri.functions import portable as P
from karakuri.plans import dims

SEPARATOR, QUEUE = " / ", 3


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{dims.WHITE}]+", ""), f"[{dims.WHITE}]+$", "")


def appended_notes(notes: Column, before: Column | None = None) -> Column:
    """Notes in order added to a note: each once, trimmed, blank ones left out; null if there are none."""
    start = F.coalesce(before, F.lit("")) if before is not None else F.lit("")

    def add(acc, note):
        new = _trim(note)
        held = F.filter(F.transform(F.split(acc, SEPARATOR), _trim), lambda x: x != "")
        return F.when((new == "") | F.array_contains(held, new), acc).otherwise(F.array_join(F.concat(held, F.array(new)), SEPARATOR))

    return F.nullif(F.aggregate(notes, start, add), F.lit(""))


def _latest(column: Column, order: Column) -> Column:
    """The last value that isn't null."""
    return F.max_by(column, F.when(column.isNotNull(), order))


def position_of() -> Column:
    """The three axes as one value, which a later one replaces whole; null without any."""
    some = F.coalesce("front_rear", "left_right", "inner_outer").isNotNull()
    return F.when(some, F.struct("front_rear", "left_right", "inner_outer"))


def _gathered(parses: DataFrame, *keys: str, seq: str) -> DataFrame:
    """(keys, item_id, status, p, value, measurements, plain, notes, last_seq) of the matched records of each item: the
    latest value of each column, readings merged by name, and the notes in order."""
    order = F.struct(seq, "ord")
    readings = [(name, F.col(name.lower())) for name in ("CO", "HC")]
    lamp = F.col("item_id") == "electrical"
    grouped = parses.where("matched").groupBy(*keys, "item_id").agg(
        _latest(F.col("status"), order).alias("status"), _latest(position_of(), order).alias("p"), _latest(F.col("value"), order).alias("value"),
        *[_latest(c, order).alias(f"_{n}") for n, c in readings],
        *[F.min(F.when(c.isNotNull(), order)).alias(f"_{n}_at") for n, c in readings],
        _latest(F.col("note"), order).alias("plain"),
        F.array_sort(F.collect_list(F.when(lamp & F.col("note").isNotNull(), F.struct(order.alias("o"), "note")))).alias("notes"),
        F.max(seq).alias("last_seq"),
    )
    entries = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"_{n}_at").alias("at"), F.lit(k).alias("k"), F.lit(n).alias("name"), F.col(f"_{n}").alias("v")) for k, (n, _) in enumerate(readings)]), lambda e: e["v"].isNotNull()))
    measurements = F.when(F.size(entries) > 0, F.map_from_entries(F.transform(entries, lambda e: F.struct(e["name"], e["v"]))))
    return grouped.select(*keys, "item_id", "status", "p", "value", measurements.alias("measurements"), "plain", F.transform("notes", lambda n: n["note"]).alias("notes"), "last_seq")


def snapshot(parses: DataFrame, *keys: str, seq: str = "uid") -> DataFrame:
    """(keys, item_id, status, front_rear, left_right, inner_outer, value, measurements, note): the matched records of
    each item, the latest value of each column; readings are merged by name; the electrical item gathers its notes."""
    note = F.when(F.col("item_id") == "electrical", appended_notes(F.col("notes"))).otherwise(F.col("plain"))
    return _gathered(parses, *keys, seq=seq).select(*keys, "item_id", "status", "p.*", "value", "measurements", note.alias("note"), "last_seq")


def merged_readings(old: Column, new: Column) -> Column:
    """Readings of two maps: the new ones count, and those that both have stay in the old one's place."""
    none = F.expr("cast(array() AS array<struct<key: string, value: double>>)")
    before = F.transform(F.coalesce(F.map_entries(old), none), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(new, e["key"]), e["value"]).alias("value")))
    after = F.filter(F.coalesce(F.map_entries(new), none), lambda e: F.coalesce(~F.map_contains_key(old, e["key"]), F.lit(True)))
    return F.when(F.coalesce(old, new).isNotNull(), F.map_from_entries(F.concat(before, after)))


def applied(stored: DataFrame, parses: DataFrame, *keys: str, now: Column, seq: str = "uid", only_stored: bool = True) -> DataFrame:
    """Stored items (keys, item_id, status, front_rear, left_right, inner_outer, value, measurements, note, updated_at)
    with the matched records applied in order: what a record has replaces the old, a position whole; readings are merged
    and the electrical item's notes added. Records of items that aren't stored are dropped, or, if only_stored is false, are new."""
    axes = ["front_rear", "left_right", "inner_outer"]
    new = _gathered(parses, *keys, seq=seq).select(*keys, "item_id", F.struct("status", "p", "value", "measurements", "plain", "notes").alias("_new"))
    both = stored.join(new, [*keys, "item_id"], "left" if only_stored else "full")
    lamp = (F.col("item_id") == "electrical") & F.col("_new").isNotNull()
    changed = {
        "status": F.coalesce("_new.status", "status"), **{a: F.when(F.col("_new.p").isNotNull(), F.col(f"_new.p.{a}")).otherwise(F.col(a)) for a in axes},
        "value": F.coalesce("_new.value", "value"), "measurements": merged_readings(F.col("measurements"), F.col("_new.measurements")),
        "note": F.when(lamp, appended_notes(F.coalesce("_new.notes", F.expr("cast(array() AS array<string>)")), F.col("note"))).otherwise(F.coalesce("_new.plain", "note")),
        "updated_at": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("updated_at")),
    }
    return both.select(*keys, "item_id", *[c.alias(n) for n, c in changed.items()])


def with_custom(items: DataFrame, confirmed: DataFrame) -> DataFrame:
    """items and the confirmed custom ones behind them; is_custom tells which are which."""
    return items.withColumn("is_custom", F.lit(False)).unionByName(confirmed.withColumn("is_custom", F.lit(True)), allowMissingColumns=True)


def queue_head(queues: DataFrame, queue: str = "queue") -> DataFrame:
    """queues with the name that waits first, the texts that show it and how many more wait, and the queue without it."""
    more = F.size(queue) - 1
    counted = lambda before, after: F.when(more > 0, F.concat(F.lit(before), more.cast("string"), F.lit(after))).otherwise(F.lit(""))
    name = F.get(queue, F.lit(0))
    return queues.withColumns({
        "head": name, "rest": F.slice(queue, F.lit(2), F.greatest(F.size(queue), F.lit(1))),
        "hint": F.concat(F.lit("未認識："), F.coalesce(F.nullif(name, F.lit("")), F.lit("（項目名なし）")), counted("　ほか", "件")),
        "title": F.concat(F.lit("未登録項目の可能性"), counted("（ほか", "件あります）")),
    })


def record_title(n: Column) -> Column:
    """The heading above n records of one utterance."""
    return F.concat(F.lit("記録"), F.when(n > 1, F.concat(F.lit("（"), n.cast("string"), F.lit("件）"))).otherwise(F.lit("")))


def unmatched_queue(parses: DataFrame, *keys: str, seq: str = "uid") -> DataFrame:
    """(keys, queue): unmatched names in order; one already in the queue is left out, and the last QUEUE stay."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(seq, "ord", "custom_name"))), lambda x: x["custom_name"])
    empty = F.expr("cast(array() AS array<string>)")

    def add(acc, name):
        longer = F.concat(acc, F.array(name))
        return F.when(F.array_contains(acc, name), acc).when(F.size(longer) > QUEUE, F.slice(longer, -QUEUE, QUEUE)).otherwise(longer)

    return parses.where("NOT matched").groupBy(*keys).agg(F.aggregate(names, empty, add).alias("queue"))


def displays(parses: DataFrame, *keys: str, seq: str = "uid", stored: DataFrame | None = None) -> DataFrame:
    """Each matched record with its item as it is shown: as it was before the utterance, with this record applied.

    stored: the items (keys, item_id, status, front_rear, left_right, inner_outer, value, co, hc, note) before the first
    utterance. The electrical item's note is what was gathered before, and this record's.
    """
    before = Window.partitionBy(*keys, "item_id").orderBy(seq).rangeBetween(Window.unboundedPreceding, -1)
    order = F.struct(seq, "ord")
    columns = ["status", "value", "co", "hc"]
    prior = {c: F.lit(None) for c in (*columns, "note", "p")}
    found = parses.where("matched")
    if stored is not None:
        held = stored.select(*keys, "item_id", F.struct(*columns, "note", position_of().alias("p")).alias("_held"))
        found = found.join(held, [*keys, "item_id"], "left")
        prior = {c: F.col(f"_held.{c}") for c in prior}
    kept = {c: F.coalesce(F.col(c), _latest(F.col(c), order).over(before), prior[c]) for c in columns}
    place = F.coalesce(position_of(), _latest(position_of(), order).over(before), prior["p"])
    gathered = F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct(order.alias("o"), "note"))).over(before))
    said = F.filter(F.concat(F.transform("_said", lambda n: n["note"]), F.array("note")), lambda n: n.isNotNull())
    note = F.when(F.col("item_id") == "electrical", appended_notes(said, F.col("_prior"))).otherwise(F.coalesce("note", "_last", "_prior"))
    rows = found.select(*keys, seq, "ord", "item_id", *[c.alias(f"_{n}") for n, c in kept.items()], place.alias("p"), "note", gathered.alias("_said"), _latest(F.col("note"), order).over(before).alias("_last"), prior["note"].cast("string").alias("_prior"))
    return rows.select(*keys, seq, "ord", "item_id", *[F.col(f"_{c}").alias(c) for c in columns], "p.*", note.alias("note"))


def fold_ctes(keys: str, seq: str = "uid") -> list[str]:
    """The snapshot of `parses` in plain SQL, for checking: an expression named `folded`, readings as text."""
    at = f"({seq} * 100 + ord)"

    def latest(c):
        return f"arg_max({c}, {at}) FILTER ({c} IS NOT NULL)"

    return [
        f"posed AS (SELECT *, CASE WHEN coalesce(front_rear, left_right, inner_outer) IS NOT NULL THEN {at} END AS posed FROM parses WHERE matched)",
        f"lamps AS (SELECT {keys}, string_agg(note, '{SEPARATOR}' ORDER BY first) AS lamps FROM (SELECT {keys}, note, min({at}) AS first FROM posed WHERE item_id = 'electrical' AND note IS NOT NULL GROUP BY {keys}, note) GROUP BY {keys})",
        f"""plainly AS (SELECT {keys}, item_id, {latest('status')} AS status, max(posed) AS posed, {latest('value')} AS value, {latest('co')} AS co, {latest('hc')} AS hc,
 min({at}) FILTER (co IS NOT NULL) AS co_at, min({at}) FILTER (hc IS NOT NULL) AS hc_at, {latest('note')} AS note FROM posed GROUP BY {keys}, item_id)""",
        f"""folded AS (SELECT {keys}, a.item_id, a.status, p.front_rear, p.left_right, p.inner_outer, a.value, CASE WHEN a.item_id = 'electrical' THEN lamps ELSE a.note END AS note, co, hc, coalesce(co_at <= hc_at, true) AS co_first
 FROM plainly a LEFT JOIN (SELECT {keys}, item_id, posed, any_value(front_rear) AS front_rear, any_value(left_right) AS left_right, any_value(inner_outer) AS inner_outer FROM posed WHERE posed IS NOT NULL GROUP BY {keys}, item_id, posed) p
 USING ({keys}, item_id, posed) LEFT JOIN lamps USING ({keys}))""",
    ]


def reading_text(co: str = "co", hc: str = "hc", first: str = "co_first") -> str:
    """SQL for both readings as they are shown, in the order in which they came."""
    c, h = f"concat('CO: ', {P.number_text(co)}, '%')", f"concat('HC: ', {P.number_text(hc)}, 'ppm')"
    return f"CASE WHEN {co} IS NULL AND {hc} IS NULL THEN NULL WHEN {hc} IS NULL THEN {c} WHEN {co} IS NULL THEN {h} WHEN {first} THEN concat({c}, ' / ', {h}) ELSE concat({h}, ' / ', {c}) END"
