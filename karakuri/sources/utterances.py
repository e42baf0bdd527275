"""Utterances made from the events table, by expressions that Spark and other SQL engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karakuri.plans import dims
from karakuri.sources.tables import table

_PLACES = ["フロント", "リア", "リヤ", "前", "後ろ", "インナー", "アウター", "右", "左", ""]
_READING = "concat('CO', cast(v / cast(100 AS double) AS string), 'HC', cast(v AS string))"
#: What is said, by event_id % 8: one item, two items, a misheard letter, a lost letter, exhaust, no item, a lamp, wide letters.
_VARIANTS = [
    "concat(place, a, cast(v % 9 AS string), 'ミリ', j)",
    "concat(a, j, place, b, cast(v % 9 AS string), 'ミリ')",
    "concat(place, left(a, 1), '※', substring(a, 3), j)",
    "concat(left(a, 2), substring(a, 4), j)",
    f"concat({_READING}, j, place, b, 'NG')",
    "concat(place, 'ぶーつ破れ ', j)",
    "concat(place, 'ウインカー球切れ、', j, a)",
    "concat(place, ' ', a, '　５．', cast(v % 9 AS string), 'mm ', j, '。')",
]


def _fields(events: str) -> str:
    """SQL for the parts that an utterance of each event is built from."""
    aliases = dims.values([(r, a) for r, _, a, _ in dims.ALIASES], "rank, alias")
    words = dims.values(list(enumerate(dims.SOURCE_JUDGEMENTS)), "rank, word")
    places = dims.values(list(enumerate(_PLACES)), "rank, place")
    return f"""SELECT e.event_id, cast(e.user_id AS string) AS inspection_id, cast(floor(e.value) AS bigint) AS v, x.alias AS a, y.alias AS b, w.word AS j, p.place
 FROM {events} e JOIN {aliases} x ON x.rank = e.event_id % {len(dims.ALIASES)} JOIN {aliases} y ON y.rank = (e.event_id * 7) % {len(dims.ALIASES)}
 JOIN {words} w ON w.rank = cast(floor(e.value) AS bigint) % {len(dims.SOURCE_JUDGEMENTS)} JOIN {places} p ON p.rank = e.user_id % {len(_PLACES)}"""


def utterances_sql(events: str = "events") -> str:
    """SQL for (uid, inspection_id, raw); uid is the event's id and orders the utterances of an inspection."""
    said = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_VARIANTS)) + " END"
    return f"SELECT event_id AS uid, inspection_id, {said} AS raw FROM ({_fields(events)}) f"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(utterances_sql("{events}"), events=table(spark, sf_dir, "events"))


def alternatives(said: DataFrame) -> DataFrame:
    """(uid, inspection_id, alternatives): each utterance behind one that lost its first two letters and a blank one."""
    return said.select("uid", "inspection_id", F.array(F.expr("substring(raw, 3)"), F.lit(" 　"), F.col("raw"), F.concat(F.col("raw"), F.lit("良好"))).alias("alternatives"))
