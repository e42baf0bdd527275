"""The registered queries of the engine, each with plain SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karakuri.functions import portable as P
from karakuri.operators import fold, parse, report, tokens, voice
from karakuri.plans import dims
from karakuri.sources import json_store as store
from karakuri.sources import sinks
from karakuri.sources.tables import table
from karakuri.sources.utterances import alternatives, utterances, utterances_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_FLAT = ", ".join(["uid", *parse.PARSE])


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def with_steps(source: str, steps: list[P.Step], select: str) -> str:
    """SQL that applies steps to an SQL source and selects from the last."""
    ctes, last = P.as_ctes("src", "s", steps)
    return f"WITH src AS ({source}), {', '.join(ctes)} SELECT {select} FROM {last}"


_SAID = f"SELECT uid, inspection_id, {P.compare_form('raw')} AS compare, {P.display_form('raw')} AS display FROM ({utterances_sql()}) u"
_PARSES = f"WITH RECURSIVE u AS ({utterances_sql()}), {', '.join(parse.parse_ctes('u'))}"
_JOINED = _PARSES.replace("parses AS (", "bare_parses AS (") + ", parses AS (SELECT u.inspection_id, p.* FROM bare_parses p JOIN u USING (uid))"
_FOLDED = f"{_JOINED}, {', '.join(fold.fold_ctes('inspection_id'))}"


def said(spark, sf_dir) -> DataFrame:
    return parse.aligned(utterances(spark, sf_dir)).drop("raw")


def parsed(spark, sf_dir) -> DataFrame:
    return parse.parse(utterances(spark, sf_dir), "inspection_id", "uid")


def snapshot(spark, sf_dir) -> DataFrame:
    return fold.snapshot(parsed(spark, sf_dir), "inspection_id")


# Normalisation

_NORM = "doc_id, md5({c}) AS compare_md5, md5({d}) AS display_md5, cast(length({c}) AS bigint) AS n_compare, cast(length({d}) AS bigint) AS n_display"


@query(f"SELECT {_NORM.format(c=P.compare_form('text'), d=P.display_form('text'))} FROM documents")
def norm_documents(spark, sf_dir):
    return parse.aligned(table(spark, sf_dir, "documents"), "text").selectExpr(*parse._split(_NORM.format(c="compare", d="display")))


@query(f"SELECT uid, compare, display FROM ({_SAID})")
def norm_utterances(spark, sf_dir):
    return said(spark, sf_dir).select("uid", "compare", "display")


# Distances

_PAIRS = f"SELECT p_partkey, upper(p_name) AS a, alias AS b FROM part JOIN {dims.values([(n % 7, f'{c} STEEL COPPER'[:n + 4]) for n, c in enumerate(['RED', 'BLUE', 'SMALL', 'LARGE', 'GREEN', 'TIN', 'BRASS'])], 'k, alias')} ON k = p_partkey % 7"


@query(f"SELECT p_partkey, levenshtein(a, b) AS edits, CASE WHEN length(a) <> length(b) THEN greatest(length(a), length(b)) ELSE hamming(a, left(concat(b, repeat(' ', 99)), length(a))) END AS differing FROM ({_PAIRS})")
def distances(spark, sf_dir):
    pairs = spark.sql(_PAIRS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return pairs.select("p_partkey", F.levenshtein("a", "b").cast("long").alias("edits"), tokens.hamming(F.col("a"), F.col("b")).cast("long").alias("differing"))


# Dictionary matching

_JUDGED = P.judgement_steps("j", "compare", "display")


@query(with_steps(_SAID, _JUDGED, f"uid, j_w AS alias, j_status AS status, {report.status_label('j_status')} AS label, j_d AS rest"))
def judgement_match(spark, sf_dir):
    return P.applied(said(spark, sf_dir), _JUDGED).selectExpr("uid", "j_w AS alias", "j_status AS status", f"{report.status_label('j_status')} AS label", "j_d AS rest")


@query(f"SELECT doc_id, {P.first_contained(P.compare_form('text'), dims.RANKED_JUDGEMENTS)} AS alias FROM documents")
def judgement_documents(spark, sf_dir):
    return parse.aligned(table(spark, sf_dir, "documents"), "text").selectExpr("doc_id", f"{P.first_contained('compare', dims.RANKED_JUDGEMENTS)} AS alias")


@query(f"SELECT uid, {P.first_contained('compare', dims.ALIASES)} AS alias FROM ({_SAID})")
def category_match(spark, sf_dir):
    return said(spark, sf_dir).selectExpr("uid", f"{P.first_contained('compare', dims.ALIASES)} AS alias")


_ALTERNATION = "(" + "|".join(a for _, _, a, _ in dims.ALIASES) + ")"


@query(f"SELECT doc_id, alias, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({P.compare_form('text')}, '{_ALTERNATION}')) AS alias FROM documents) GROUP BY doc_id, alias")
def token_documents(spark, sf_dir):
    found = parse.aligned(table(spark, sf_dir, "documents"), "text").select("doc_id", F.explode(tokens.exact_items(F.col("compare"))).alias("alias"))
    return found.groupBy("doc_id", "alias").agg(F.count("*").alias("n"))


@query(f"{_PARSES} SELECT uid, start, stop, item_id, alias, match_type FROM said JOIN toks USING (compare)")
def token_occurrences(spark, sf_dir):
    texts = said(spark, sf_dir)
    found = tokens.tokens_of(texts).select("compare", F.explode("tokens").alias("t"))
    return texts.join(found, "compare").select("uid", F.col("t.start"), F.col("t.end").alias("stop"), "t.item_id", "t.alias", "t.match_type")


@query(f"{_PARSES} SELECT uid, start, stop, item_id, alias FROM said JOIN toks USING (compare) WHERE match_type = 'fuzzy'")
def token_fuzzy(spark, sf_dir):
    return token_occurrences(spark, sf_dir).where("match_type = 'fuzzy'").drop("match_type")


@query(f"{_PARSES} SELECT uid, k, n_tok, start, stop, prev_stop, cast(next_start AS int) AS next_start, item_id FROM said JOIN bounds USING (compare)")
def segment_gaps(spark, sf_dir):
    """Merged tokens with the bounds of their neighbours."""
    return parse.segments(parse.with_tokens(utterances(spark, sf_dir)), "uid").select("uid", "k", "n_tok", "start", "stop", "prev_stop", "next_start", "item_id")


@query(f"{_PARSES} SELECT uid, item_id, status, front_rear, left_right, inner_outer, value FROM parses WHERE match_type = 'approx'")
def approx_match(spark, sf_dir):
    return parsed(spark, sf_dir).where("match_type = 'approx'").select("uid", "item_id", "status", "front_rear", "left_right", "inner_outer", "value")


# Attributes of segments

_POSED = P.position_steps("p", "compare", "display")
_TAIL, _HEAD = P.peel_steps("t", "compare", "right"), P.peel_steps("h", "compare", "left")
_MEASURED = P.measure_steps("m", "compare", "display")


@query(with_steps(_SAID, _POSED, "uid, p_fr, p_lr, p_io, p_c, p_d"))
def position_extract(spark, sf_dir):
    return P.applied(said(spark, sf_dir), _POSED).select("uid", "p_fr", "p_lr", "p_io", "p_c", "p_d")


@query(with_steps(_SAID, [*_TAIL, *_HEAD], "uid, t_fr, t_lr, t_io, t_n, h_fr, h_lr, h_io, h_n"))
def position_peel(spark, sf_dir):
    return P.applied(said(spark, sf_dir), [*_TAIL, *_HEAD]).select("uid", "t_fr", "t_lr", "t_io", F.col("t_n").cast("long"), "h_fr", "h_lr", "h_io", F.col("h_n").cast("long"))


_SHOWN = f"uid, m_value, {P.number_text('m_value')} AS shown, {P.number_text('(m_value / cast(2000 AS double))')} AS shown_small, {P.number_text('(floor(m_value) * cast(12345678 AS double) + cast(0.5 AS double))')} AS shown_large, {P.note_of('m_d')} AS rest"


@query(with_steps(_SAID, _MEASURED, _SHOWN))
def measurement_extract(spark, sf_dir):
    return P.applied(said(spark, sf_dir), _MEASURED).selectExpr(*parse._split(_SHOWN))


@query(f"{_PARSES} SELECT uid, ord, co, hc, status, note FROM parses WHERE co IS NOT NULL OR hc IS NOT NULL")
def co_hc_extract(spark, sf_dir):
    return parsed(spark, sf_dir).where("co IS NOT NULL OR hc IS NOT NULL").select("uid", "ord", "co", "hc", "status", "note")


@query(f"{_PARSES} SELECT {_FLAT} FROM parses")
def parse_full(spark, sf_dir):
    return parsed(spark, sf_dir).select("uid", *parse.PARSE)


@query(f"{_PARSES} SELECT uid, ord, match_type, status, note FROM parses WHERE item_id = 'electrical'")
def electrical_parse(spark, sf_dir):
    return parsed(spark, sf_dir).where("item_id = 'electrical'").select("uid", "ord", "match_type", "status", "note")


@query(f"{_PARSES} SELECT uid, status, custom_name FROM parses WHERE NOT matched")
def unmatched_parse(spark, sf_dir):
    return parsed(spark, sf_dir).where("NOT matched").select("uid", "status", "custom_name")


@query(f"{_PARSES} SELECT item_id, status, count(*) AS n FROM parses WHERE matched GROUP BY item_id, status")
def status_counts(spark, sf_dir):
    return parsed(spark, sf_dir).where("matched").groupBy("item_id", "status").agg(F.count("*").alias("n"))


_CANDIDATES = f"""SELECT uid * 10 + alt AS uid, raw FROM (SELECT uid, unnest([0, 1, 2]) AS alt, unnest([{P.trimmed('substring(raw, 3)')}, {P.trimmed('raw')}, {P.trimmed("concat(raw, '良好')")}]) AS raw FROM ({utterances_sql()}) u) WHERE raw <> ''"""


@query(f"""WITH RECURSIVE u AS ({_CANDIDATES}), {', '.join(parse.parse_ctes('u'))},
 scored AS (SELECT uid, sum(CASE WHEN NOT matched THEN -3 WHEN match_type = 'exact' THEN 15 ELSE 10 END) AS score, count(*) AS n FROM parses GROUP BY uid),
 best AS (SELECT *, row_number() OVER (PARTITION BY uid // 10 ORDER BY score DESC, uid) AS r FROM scored)
 SELECT uid // 10 AS uid, raw, cast(score AS bigint) AS score, n FROM best JOIN u USING (uid) WHERE r = 1""")
def nbest_choose(spark, sf_dir):
    chosen = parse.choose_best(alternatives(utterances(spark, sf_dir)), "uid", "inspection_id")
    return chosen.groupBy("uid", "raw", "score").agg(F.count("*").alias("n"))


# Folds

@query(f"{_FOLDED} SELECT inspection_id, item_id, status, front_rear, left_right, inner_outer, value, {fold.reading_text()} AS readings, note FROM folded")
def fold_snapshot(spark, sf_dir):
    found = snapshot(spark, sf_dir)
    return found.selectExpr("inspection_id", "item_id", "status", "front_rear", "left_right", "inner_outer", "value", f"{report.readings_of()} AS readings", "note")


@query(f"{_FOLDED} SELECT inspection_id, note FROM folded WHERE item_id = 'electrical'")
def electrical_notes(spark, sf_dir):
    return snapshot(spark, sf_dir).where("item_id = 'electrical'").select("inspection_id", "note")


@query(f"""{_JOINED} SELECT inspection_id, array_to_string(list_reduce(list([custom_name] ORDER BY uid), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x)[-3:] END), '|') AS queue
 FROM parses WHERE NOT matched GROUP BY inspection_id""")
def unmatched_queue(spark, sf_dir):
    return fold.unmatched_queue(parsed(spark, sf_dir), "inspection_id").select("inspection_id", F.array_join("queue", "|").alias("queue"))


def _before(c: str) -> str:
    return f"coalesce({c}, arg_max({c}, uid * 100 + ord) FILTER ({c} IS NOT NULL) OVER w) AS {c}"


@query(f"""{_JOINED} SELECT uid, ord, item_id, {', '.join(map(_before, ('status', 'value', 'co', 'hc')))},
 CASE WHEN posed IS NULL THEN split_part(max(CASE WHEN posed IS NOT NULL THEN concat(lpad(cast(uid * 100 + ord AS string), 12, '0'), '|', posed) END) OVER w, '|', 2) ELSE posed END AS place
 FROM (SELECT *, CASE WHEN coalesce(front_rear, left_right, inner_outer) IS NOT NULL THEN concat(coalesce(front_rear, '-'), '/', coalesce(left_right, '-'), '/', coalesce(inner_outer, '-')) END AS posed FROM parses WHERE matched)
 WINDOW w AS (PARTITION BY inspection_id, item_id ORDER BY uid RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def display_snapshot(spark, sf_dir):
    place = F.when(F.coalesce("front_rear", "left_right", "inner_outer").isNotNull(), F.concat_ws("/", *[F.coalesce(c, F.lit("-")) for c in ("front_rear", "left_right", "inner_outer")]))
    return fold.displays(parsed(spark, sf_dir), "inspection_id").select("uid", "ord", "item_id", "status", "value", "co", "hc", place.alias("place"))


# Store

def orders_store(spark, sf_dir):
    """Orders as stored documents; their keys are 1, 2, ... so that the place follows without a global window."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("store_ord"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("total"))


_STORE = "SELECT o_orderkey AS id, o_orderkey AS store_ord, o_orderstatus AS status, cast(o_orderdate AS date) AS updated_at, o_totalprice AS total FROM orders"
_CHANGED = """SELECT id, min(store_ord) AS store_ord, max(status) AS status, arg_max(updated_at, store_ord) AS updated_at, arg_max(total, store_ord) AS total FROM
 (SELECT CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey ELSE 10000000 + o_orderkey - o_orderkey % 30 END AS id, o_orderkey AS store_ord, 'X' AS status, cast(o_orderdate AS date) AS updated_at, cast(o_orderkey AS double) AS total FROM orders WHERE o_orderkey % 10 = 0) GROUP BY id"""


@query(f"""WITH s AS ({_STORE}), c AS ({_CHANGED}) SELECT s.id, s.store_ord, coalesce(c.status, s.status) AS status, coalesce(c.updated_at, s.updated_at) AS updated_at, coalesce(c.total, s.total) AS total FROM s LEFT JOIN c USING (id)
 UNION ALL SELECT id, (SELECT max(store_ord) FROM s) + 1 + store_ord, status, updated_at, total FROM c WHERE id NOT IN (SELECT id FROM s)""")
def upsert_store(spark, sf_dir):
    """Stored documents and new ones, some of which change twice."""
    held = orders_store(spark, sf_dir)
    changed = held.where("id % 10 = 0").selectExpr("CASE WHEN id % 20 = 0 THEN id ELSE 10000000 + id - id % 30 END AS id", "store_ord", "'X' AS status", "updated_at", "cast(store_ord AS double) AS total")
    return store.upsert(held, changed, "id").select("id", "store_ord", "status", "updated_at", "total")


@query(f"SELECT * FROM ({_STORE}) WHERE status <> 'F'")
def delete_store(spark, sf_dir):
    held = orders_store(spark, sf_dir)
    return store.delete(held, held.where("status = 'F'"), "id")


@query(f"SELECT id, updated_at, total FROM ({_STORE}) ORDER BY updated_at DESC, store_ord")
def list_store(spark, sf_dir):
    """The whole store, newest first."""
    return store.listing(orders_store(spark, sf_dir)).select("id", "updated_at", "total")


@query(f"SELECT id, status, total FROM ({_STORE}) WHERE id = 7")
def get_store(spark, sf_dir):
    return store.get(orders_store(spark, sf_dir), "id", 7).select("id", "status", "total")


_VALUE = "CASE event_id % 4 WHEN 0 THEN concat(chr(10), ' [', props, ',{\"k\":-1}]') WHEN 1 THEN props WHEN 2 THEN 'not json' ELSE concat('[', props, ']') END"


@query("SELECT event_id, store_ord, k FROM (SELECT event_id, 0 AS store_ord, cast(json_extract(props, '$.k') AS bigint) AS k FROM events WHERE event_id % 4 IN (0, 3) UNION ALL SELECT event_id, 1, -1 FROM events WHERE event_id % 4 = 0)")
def json_scan(spark, sf_dir):
    return store.scan(table(spark, sf_dir, "events").selectExpr("event_id", f"{_VALUE} AS value"), "value", "k bigint")


@query("SELECT event_id, concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}') AS value FROM events")
def json_write(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", store.document(["event_id", "event_type"]).alias("value"))


@query("SELECT user_id, concat('[', string_agg(concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}'), ',' ORDER BY event_id), ']') AS value FROM events GROUP BY user_id")
def array_write(spark, sf_dir):
    """Every user's stored list written back as one JSON array."""
    return store.arrays(table(spark, sf_dir, "events"), ["event_id", "event_type"], "user_id", order="event_id")


_ASKED = "SELECT c_custkey, concat(' ', c_name, '　') AS name, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END AS model, concat(cast(cast(floor(abs(c_acctbal)) AS bigint) AS string), CASE WHEN c_custkey % 2 = 0 THEN ',000km' ELSE '１２' END) AS mileage, 1700000000000 + c_custkey AS millis FROM {customer}"
_CREATED = f"""SELECT c_custkey, concat(cast(millis AS string), '_', left(md5(cast(c_custkey AS string)), 6)) AS id, {P.trimmed('name')} AS customer_name, {P.trimmed('model')} AS vehicle_model,
 nullif(regexp_replace(mileage, '[^0-9]', '', 'g'), '') AS mileage, strftime(make_timestamp(millis * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, strftime(make_timestamp(millis * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at FROM ({_ASKED.format(customer='customer')})"""


@query(_CREATED)
def create_inspection(spark, sf_dir):
    return store.create(spark.sql(_ASKED, customer=table(spark, sf_dir, "customer")), "millis", "c_custkey")


@query(f"SELECT c_custkey, ord, item_id, category, 'unset' AS status FROM customer CROSS JOIN {dims.values([(k, i, n) for k, (_, i, n, _) in enumerate(dims.CHECKLIST)], 'ord, item_id, category')}")
def default_items(spark, sf_dir):
    return store.default_items(table(spark, sf_dir, "customer"), "c_custkey")


_OLD = [*[(k, i) for k, (_, i, _, _) in enumerate(dims.CHECKLIST)], (33, "tire"), (34, "brake_lining"), (35, "custom_1"), (36, "custom_2")]
_STORED = f"""SELECT user_id, cast(event_id AS int) AS ord, item_id, concat('old ', item_id) AS category, CASE WHEN event_id % 3 = 0 THEN 'unset' ELSE 'good' END AS status,
 CASE WHEN event_id % 5 = 0 THEN 'n' END AS note, event_id % 7 = 0 AS posed, CASE WHEN event_id % 14 = 0 THEN 'rear' END AS front_rear, event_id % 11 = 0 AS measured, CASE WHEN event_id % 22 = 0 THEN value END AS value,
 CASE WHEN event_id % 13 = 0 THEN cast(0.02 AS double) END AS co, CASE WHEN event_id % 2 = 0 THEN concat('t', cast(event_id AS string)) END AS updated_at FROM {{events}} JOIN {dims.values(_OLD, 'k, item_id')} ON k = event_id % {len(_OLD)}"""
_WHOLE_ITEM = "position IS NOT NULL AS posed, position.front_rear AS front_rear, measurement IS NOT NULL AS measured, measurement.value AS value, measurement.unit AS unit, try_element_at(measurements, 'CO') AS co, updated_at"


def stored_items(spark, sf_dir) -> DataFrame:
    """Items as they are stored, with empty positions and measurements among them."""
    rows = spark.sql(_STORED, events=table(spark, sf_dir, "events"))
    return rows.selectExpr(
        "user_id", "ord", "item_id", "category", "status", "note", "CASE WHEN posed THEN named_struct('front_rear', front_rear, 'left_right', cast(NULL AS string), 'inner_outer', cast(NULL AS string)) END AS position",
        "CASE WHEN measured THEN named_struct('value', value, 'unit', CASE WHEN value IS NOT NULL THEN 'mm' END) END AS measurement", "CASE WHEN co IS NOT NULL THEN map('CO', co) END AS measurements", "updated_at",
    )


_RECONCILED = f"""WITH st AS ({_STORED.format(events='events')}), v AS (SELECT user_id, item_id, min(ord) AS first_ord, max(ord) AS ord FROM st GROUP BY user_id, item_id),
 l AS (SELECT first_ord, st.* FROM v JOIN st USING (user_id, item_id, ord)),
 dim AS (SELECT * FROM {dims.values([(k, i, n) for k, (_, i, n, _) in enumerate(dims.CHECKLIST)], 'ord, item_id, category')}),
 whole AS (SELECT u.user_id, dim.ord, dim.item_id, dim.category, coalesce(l.status, 'unset') AS status, l.note, false AS is_custom, coalesce(l.posed, false) AS posed, l.front_rear, coalesce(l.measured, false) AS measured,
 CASE WHEN l.measured THEN l.value END AS value, l.co, l.updated_at FROM (SELECT DISTINCT user_id FROM st) u CROSS JOIN dim LEFT JOIN l ON l.user_id = u.user_id AND l.item_id = dim.item_id
 UNION ALL SELECT user_id, first_ord + 33, item_id, category, status, note, true, posed, front_rear, measured, CASE WHEN measured THEN value END, co, updated_at FROM l
 WHERE item_id NOT IN (SELECT item_id FROM dim) AND (status <> 'unset' OR coalesce(note, '') <> '' OR posed OR measured OR co IS NOT NULL))"""
_RECONCILED_AS = "ord, item_id, category, status, note, is_custom, posed, front_rear, measured, value, CASE WHEN value IS NOT NULL THEN 'mm' END AS unit, co, updated_at"


@query(f"{_RECONCILED} SELECT user_id, {_RECONCILED_AS} FROM whole")
def reconcile_items(spark, sf_dir):
    return store.reconcile(stored_items(spark, sf_dir), "user_id").selectExpr("user_id", "ord", "item_id", "category", "status", "note", "is_custom", *parse._split(_WHOLE_ITEM))


@query(f"{_RECONCILED} SELECT 7 AS id, {_RECONCILED_AS} FROM whole WHERE user_id = (SELECT min(c_custkey) FROM customer WHERE c_custkey % 100 = 7)")
def get_inspection(spark, sf_dir):
    """The first document of one id, its items brought in line with the checklist."""
    held = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey % 100 AS int) AS id", "c_custkey AS store_ord")
    items = stored_items(spark, sf_dir).withColumnRenamed("user_id", "store_ord")
    return store.get_reconciled(held, items, "id", 7).selectExpr("id", "ord", "item_id", "category", "status", "note", "is_custom", *parse._split(_WHOLE_ITEM))


_HELD = f"""SELECT user_id, cast(user_id AS string) AS inspection_id, k, item_id, CASE WHEN (user_id + k) % 5 = 0 THEN 'good' ELSE 'unset' END AS status, CASE WHEN (user_id + k) % 4 = 0 THEN 'front' END AS front_rear,
 CASE WHEN (user_id + k) % 7 = 0 THEN cast(1.5 AS double) END AS value, CASE WHEN item_id = 'co_hc' AND user_id % 2 = 0 THEN cast(9 AS double) END AS hc, CASE WHEN item_id = 'electrical' THEN '前回' WHEN (user_id + k) % 6 = 0 THEN 'n' END AS note FROM {{source}} WHERE (user_id + k) % 3 <> 0"""
_HELD_SQL = _HELD.format(source=f"(SELECT DISTINCT user_id FROM events) CROSS JOIN {dims.values([(k, i) for k, (_, i, _, _) in enumerate(dims.CHECKLIST)], 'k, item_id')}")


@query(f"""{_FOLDED}, held AS ({_HELD_SQL}) SELECT h.inspection_id, h.item_id, coalesce(f.status, h.status) AS status, CASE WHEN coalesce(f.front_rear, f.left_right, f.inner_outer) IS NOT NULL THEN f.front_rear ELSE h.front_rear END AS front_rear, f.left_right, f.inner_outer,
 coalesce(f.value, h.value) AS value, CASE WHEN h.hc IS NULL THEN {fold.reading_text('f.co', 'f.hc', 'f.co_first')} ELSE concat('HC: ', {P.number_text('coalesce(f.hc, h.hc)')}, 'ppm', CASE WHEN f.co IS NOT NULL THEN concat(' / CO: ', {P.number_text('f.co')}, '%') ELSE '' END) END AS readings,
 CASE WHEN h.item_id = 'electrical' THEN concat_ws(' / ', h.note, f.note) ELSE coalesce(f.note, h.note) END AS note, CASE WHEN f.item_id IS NULL THEN 'before' ELSE 'now' END AS updated_at FROM held h LEFT JOIN folded f USING (inspection_id, item_id)""")
def fold_onto_stored(spark, sf_dir):
    """Records applied to the items that an inspection has; those of other items are dropped."""
    users = store.default_items(table(spark, sf_dir, "events").select("user_id").distinct(), "user_id").withColumnRenamed("ord", "k").select("user_id", "k", "item_id")
    held = spark.sql(_HELD.format(source="{users}"), users=users).selectExpr("inspection_id", "item_id", "status", "front_rear", "cast(NULL AS string) AS left_right", "cast(NULL AS string) AS inner_outer", "value", "CASE WHEN hc IS NOT NULL THEN map('HC', hc) END AS measurements", "note", "'before' AS updated_at")
    found = fold.applied(held, parsed(spark, sf_dir), "inspection_id", now=F.lit("now"))
    return found.selectExpr("inspection_id", "item_id", "status", "front_rear", "left_right", "inner_outer", "value", f"{report.readings_of()} AS readings", "note", "updated_at")


@query(f"{_FOLDED} SELECT inspection_id, item_id, CASE WHEN item_id LIKE '%boot' THEN 'good' ELSE status END AS status, CASE WHEN item_id LIKE '%boot' THEN NULL ELSE value END AS value, CASE WHEN item_id LIKE '%boot' THEN 'edited' ELSE note END AS note FROM folded")
def manual_edit(spark, sf_dir):
    items = snapshot(spark, sf_dir)
    empty = [F.lit(None).cast("string").alias(c) for c in ("front_rear", "left_right", "inner_outer")]
    edits = items.where("item_id LIKE '%boot'").select("inspection_id", "item_id", F.lit("good").alias("status"), *empty, F.lit(None).cast("double").alias("value"), F.lit("edited").alias("note"))
    return store.edited(items, edits, "inspection_id", "item_id").select("inspection_id", "item_id", "status", "value", "note")


_CUSTOM = "SELECT inspection_id, concat('custom_', left(md5(custom_name), 6)) AS item_id, custom_name AS category, coalesce(arg_max(status, uid), 'unset') AS status, true AS is_custom FROM parses WHERE NOT matched AND custom_name <> '' GROUP BY inspection_id, custom_name"


def confirmed(parses: DataFrame) -> DataFrame:
    """Unmatched names taken over as items of their own."""
    names = parses.where("NOT matched AND custom_name <> ''").groupBy("inspection_id", "custom_name").agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("uid"))).alias("status"))
    return names.select("inspection_id", F.concat(F.lit("custom_"), F.substring(F.md5("custom_name"), 1, 6)).alias("item_id"), F.col("custom_name").alias("category"), F.coalesce("status", F.lit("unset")).alias("status"))


def items_with_custom(spark, sf_dir) -> DataFrame:
    parses = parsed(spark, sf_dir)
    return fold.with_custom(fold.snapshot(parses, "inspection_id"), confirmed(parses))


@query(f"{_FOLDED} SELECT inspection_id, item_id, cast(NULL AS string) AS category, status, false AS is_custom FROM folded UNION ALL {_CUSTOM}")
def confirm_custom(spark, sf_dir):
    """The items of each inspection, and behind them the unmatched names taken over as custom ones."""
    return items_with_custom(spark, sf_dir).select("inspection_id", "item_id", "category", "status", "is_custom")


_QUEUE = "list_reduce(list([custom_name] ORDER BY uid), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x)[-3:] END)"


@query(f"""{_JOINED}, q AS (SELECT inspection_id, {_QUEUE} AS q FROM parses WHERE NOT matched GROUP BY inspection_id) SELECT inspection_id, q[1] AS head, array_to_string(q[2:], '|') AS rest,
 concat('未認識：', CASE WHEN q[1] = '' THEN '（項目名なし）' ELSE q[1] END, CASE WHEN len(q) > 1 THEN concat('　ほか', len(q) - 1, '件') ELSE '' END) AS hint, concat('未登録項目の可能性', CASE WHEN len(q) > 1 THEN concat('（ほか', len(q) - 1, '件あります）') ELSE '' END) AS title FROM q""")
def queue_head(spark, sf_dir):
    """The unmatched name that waits first, how it is shown, and the queue once it is done."""
    found = fold.queue_head(fold.unmatched_queue(parsed(spark, sf_dir), "inspection_id"))
    return found.select("inspection_id", "head", F.array_join("rest", "|").alias("rest"), "hint", "title")


@query(f"{_PARSES} SELECT uid, concat('記録', CASE WHEN count(*) > 1 THEN concat('（', count(*), '件）') ELSE '' END) AS title FROM parses WHERE matched GROUP BY uid")
def record_counts(spark, sf_dir):
    return parsed(spark, sf_dir).where("matched").groupBy("uid").agg(F.count("*").alias("n")).select("uid", fold.record_title(F.col("n")).alias("title"))


# Reports

_DIM = dims.values([(k, i, n) for k, (_, i, n, _) in enumerate(dims.CHECKLIST)], "ord, item_id, category")
_LABELLED = f"{_FOLDED}, lined AS (SELECT *, {report.summary_line(fold.reading_text())} AS line FROM folded JOIN {_DIM} USING (item_id))"


@query(f"{_LABELLED} SELECT inspection_id, item_id, line, {report.full_label('line')} AS label, {report.record_lines()} AS record FROM lined")
def item_label(spark, sf_dir):
    return report.labelled(snapshot(spark, sf_dir)).selectExpr("inspection_id", "item_id", "line", "label", f"{report.record_lines()} AS record")


@query(f"{_LABELLED} SELECT inspection_id, status, count(*) AS n FROM lined WHERE status IN ({P.literals(dims.PROBLEMS)}) GROUP BY inspection_id, status")
def problem_items(spark, sf_dir):
    return snapshot(spark, sf_dir).where(F.col("status").isin(dims.PROBLEMS)).groupBy("inspection_id", "status").agg(F.count("*").alias("n"))


_HEADS = "SELECT cast(c_custkey AS string) AS inspection_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS customer_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS vehicle_model, CASE WHEN c_custkey % 3 = 1 THEN cast(c_custkey AS string) END AS mileage FROM {customer}"
_TITLES = dims.values([(k, s, label) for k, (s, label, _) in enumerate(dims.STATUSES[:6])], "summary_ord, status, title")


@query(f"""{_LABELLED}, every AS (SELECT inspection_id, status, ord, {report.full_label('line')} AS label FROM lined UNION ALL SELECT inspection_id, status, {len(dims.CHECKLIST)}, category FROM ({_CUSTOM})),
 blocks AS (SELECT inspection_id, summary_ord, concat('【', title, '】', chr(10), string_agg(concat('・', label), chr(10) ORDER BY ord, label)) AS block
 FROM every JOIN {_TITLES} USING (status) GROUP BY inspection_id, summary_ord, title),
 bodies AS (SELECT inspection_id, string_agg(block, chr(10) || chr(10) ORDER BY summary_ord) AS body FROM blocks GROUP BY inspection_id)
 SELECT inspection_id, concat_ws(chr(10) || chr(10), nullif({report.header_text()}, ''), coalesce(body, '{report.NOTHING}')) AS memo FROM ({_HEADS.format(customer='customer')}) h LEFT JOIN bodies USING (inspection_id)""")
def summary_text(spark, sf_dir):
    """A memo for every customer, of checklist items and custom ones."""
    heads = spark.sql(_HEADS, customer=table(spark, sf_dir, "customer"))
    return report.memo(heads, items_with_custom(spark, sf_dir), "inspection_id")


@query(f"""SELECT inspection_id, concat_ws(' / ', coalesce(nullif(customer_name, ''), 'お客様名未入力'), nullif(vehicle_model, '')) AS list_title,
 concat_ws(' / ', coalesce(nullif(customer_name, ''), 'お客様名未入力'), nullif(vehicle_model, ''), CASE WHEN mileage <> '' THEN concat(mileage, 'km') END) AS page_title FROM ({_HEADS.format(customer='customer')})""")
def titles(spark, sf_dir):
    """What names an inspection in the list and on its page, with what stands for a missing customer."""
    return store.titled(spark.sql(_HEADS, customer=table(spark, sf_dir, "customer"))).select("inspection_id", "list_title", "page_title")


# Events

@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(spark, sf_dir):
    """Named events, counted."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


_CODES = dims.values([(t, c) for t, c in zip(["view", "error", "purchase", "signup", "click"], ["no-speech", "network", "aborted", "other", "audio-capture"])], "event_type, code")


@query(f"SELECT event_id, code, coalesce(message, concat('エラーコード: ', code)) AS message, code IN ({P.literals(dims.CONTINUES)}) AS goes_on FROM events JOIN {_CODES} USING (event_type) LEFT JOIN {dims.values(dims.VOICE_ERRORS, 'code, message')} USING (code)")
def voice_error_policy(spark, sf_dir):
    coded = spark.sql(f"SELECT event_id, code FROM {{events}} JOIN {_CODES} USING (event_type)", events=table(spark, sf_dir, "events"))
    known = F.broadcast(dims.frame(spark, dims.VOICE_ERRORS, "code string, message string"))
    return coded.join(known, "code", "left").select("event_id", "code", F.coalesce("message", F.concat(F.lit("エラーコード: "), "code")).alias("message"), F.col("code").isin(dims.CONTINUES).alias("goes_on"))


_HAPPENED = f"SELECT user_id AS key, event_id AS seq, kind, CASE event_id % 3 WHEN 0 THEN 'no-speech' WHEN 1 THEN 'network' ELSE '' END AS code FROM {{events}} JOIN {dims.values([(0, 'start'), (1, 'started'), (2, 'result'), (3, 'end'), (4, 'start'), (5, 'error'), (6, 'end'), (7, 'stop'), (8, 'error'), (9, 'start'), (10, 'started'), (11, 'result'), (12, 'start_failed'), (13, 'end'), (14, 'unsupported')], 'k, kind')} ON k = (event_id * 7 + user_id) % 15"


@query(f"WITH RECURSIVE happened AS ({_HAPPENED.format(events='events')}), {', '.join(voice.state_ctes('happened'))} SELECT key, seq, kind, state, wants, code, label FROM states JOIN {dims.values(dims.VOICE_STATES, 'state, label')} USING (state)")
def session_states(spark, sf_dir):
    """The recogniser's state after each event of a session: starts, results, errors, stops and restarts."""
    found = voice.session_states(spark.sql(_HAPPENED, events=table(spark, sf_dir, "events")), "key", "seq")
    return found.join(F.broadcast(dims.frame(spark, dims.VOICE_STATES, "state string, label string")), "state").select("key", "seq", "kind", "state", "wants", "code", "label")


@query(f"SELECT user_id, event_id, strftime(ts, '%-m/%-d %H:%M') AS shown FROM events")
def date_display(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "M/d HH:mm").alias("shown"))


@query(f"SELECT status, label, css, ui_ord FROM {dims.values([(s, label, css, k) for k, (s, label, css) in enumerate(dims.STATUSES)], 'status, label, css, ui_ord')}")
def status_labels(spark, sf_dir):
    return dims.status_dim(spark).select("status", "label", "css", "ui_ord")


_NAMED = f"SELECT event_id, ts, name AS event_name, CASE WHEN user_id % 4 = 0 THEN 'test' ELSE 'app' END AS host FROM {{events}} JOIN {dims.values([*enumerate(dims.APP_EVENTS), (6, 'unknown')], 'k, name')} ON k = event_id % 7"


@query(f"SELECT event_name, count(*) AS n, count(DISTINCT ts) AS times FROM ({_NAMED.format(events='events')}) WHERE host = 'app' AND event_name <> 'unknown' GROUP BY event_name")
def app_event_counts(spark, sf_dir):
    """Payload-free events of one host, by name."""
    kept = sinks.app_events(spark.sql(_NAMED, events=table(spark, sf_dir, "events")), "app")
    return kept.groupBy("event_name").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("times"))


@query(f"{_PARSES} SELECT uid, item_id, match_type, status, custom_name FROM parses WHERE ord = 0")
def first_parse(spark, sf_dir):
    """The first record of each utterance."""
    return parsed(spark, sf_dir).where("ord = 0").select("uid", "item_id", "match_type", "status", "custom_name")


@query(f"SELECT uid, CASE WHEN j_w IS NULL THEN compare ELSE j_c END AS without_judgement, {P.without('compare', 'compare', 'found')} AS without_item FROM (SELECT *, {P.first_contained('compare', dims.ALIASES)} AS found FROM ({with_steps(_SAID, _JUDGED, '*')}))")
def alias_removal(spark, sf_dir):
    """Texts less the first place of their judgement, and less that of their item."""
    found = P.applied(said(spark, sf_dir), [*_JUDGED, {"found": P.first_contained("compare", dims.ALIASES)}])
    return found.selectExpr("uid", "j_c AS without_judgement", f"{P.without('compare', 'compare', 'found')} AS without_item")


_TYPED = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(' ', cast(event_id % 50 AS string), '.5 ') WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE cast(event_id AS string) END AS typed FROM {events}"


@query(f"SELECT event_id, try_cast({P.trimmed('typed')} AS double) AS value FROM ({_TYPED.format(events='events')})")
def typed_numbers(spark, sf_dir):
    return spark.sql(_TYPED, events=table(spark, sf_dir, "events")).select("event_id", store.typed_value(F.col("typed")).alias("value"))


@query("SELECT o_orderkey AS id, o_orderstatus = 'P' AS is_custom FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderstatus = 'P')")
def custom_delete(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("is_custom"))
    return store.delete_custom(items, items.where("id % 3 = 0"), "id")
