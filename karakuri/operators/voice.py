"""The recogniser's sessions: their states as a fold over what happens, in SQL that other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.functions import portable as P
from karakuri.plans import dims

#: What can happen: a tap on start or stop, and what the recogniser tells. An error without a code is unknown.
KINDS = ["start", "started", "result", "error", "end", "stop", "start_failed", "unsupported"]
#: State before anything happened: shown state, whether listening is wanted, whether the user stopped it, whether an error
#: was fatal, whether a session runs, and the code of the last error.
FIRST = {"state": "'idle'", "wants": "false", "manual": "false", "fatal": "false", "active": "false", "code": "cast(NULL AS string)"}


def next_state(w: str, e: str) -> dict[str, str]:
    """SQL for each part of the state after an event e (kind, code) in a state w.

    A second start while a session runs does nothing. Errors after a manual stop are ignored; others are shown, and all
    but those that let listening go on are fatal. A session that ends starts again as long as listening is wanted; after
    a fatal error the error stays shown. A start that fails is an error of its own.
    """
    goes_on = f"{e}.code IN ({P.literals(dims.CONTINUES)})"
    begins, heard = f"({e}.kind = 'start' AND NOT {w}.active)", f"({e}.kind = 'error' AND NOT {w}.manual)"
    fatal = f"({heard} AND NOT {goes_on})"
    return {
        "state": f"CASE WHEN {e}.kind = 'started' THEN 'listening' WHEN {e}.kind = 'result' THEN 'processing' WHEN {heard} OR {e}.kind = 'start_failed' THEN 'error' WHEN {e}.kind = 'unsupported' THEN 'unsupported'"
        f" WHEN {e}.kind = 'stop' OR {e}.kind = 'end' AND ({w}.manual OR NOT {w}.wants AND NOT {w}.fatal) THEN 'idle' ELSE {w}.state END",
        "wants": f"CASE WHEN {begins} THEN true WHEN {fatal} OR {e}.kind IN ('stop', 'start_failed') THEN false ELSE {w}.wants END",
        "manual": f"CASE WHEN {begins} OR {e}.kind = 'end' THEN false WHEN {e}.kind = 'stop' THEN true ELSE {w}.manual END",
        "fatal": f"CASE WHEN {fatal} THEN true WHEN {e}.kind = 'end' AND NOT {w}.manual AND NOT {w}.wants THEN false ELSE {w}.fatal END",
        "active": f"CASE {e}.kind WHEN 'start' THEN true WHEN 'end' THEN NOT {w}.manual AND {w}.wants WHEN 'start_failed' THEN false ELSE {w}.active END",
        "code": f"CASE WHEN {heard} THEN {e}.code WHEN {e}.kind = 'start_failed' THEN 'start-failed' WHEN {begins} OR {e}.kind IN ('stop', 'result') THEN cast(NULL AS string) ELSE {w}.code END",
    }


def session_states(events: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, kind, state, wants, manual, fatal, active, code) after each event (key, seq, kind, code) of a session."""
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), "kind", F.coalesce(F.nullif("code", F.lit("")), F.lit("unknown")).alias("code")))).alias("es"))
    state = lambda parts: "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in parts.items()) + ")"
    walked = F.expr(f"aggregate(es, array({state(FIRST)}), (ws, e) -> concat(ws, array({state(next_state('element_at(ws, -1)', 'e'))})))")
    each = listed.withColumn("ws", walked).select(key, F.explode(F.arrays_zip("es", F.expr("slice(ws, 2, size(es))").alias("ws"))).alias("x"))
    return each.select(key, F.col("x.es.seq").alias(seq), "x.es.kind", "x.ws.*")


def state_ctes(source: str) -> list[str]:
    """The states of `source` (key, seq, kind, code) by recursion, for checking: an expression named `states`."""
    after = ", ".join(f"{x} AS {n}" for n, x in next_state("w", "e").items())
    first = ", ".join(f"{x} AS {n}" for n, x in next_state("f", "e").items())
    return [
        f"numbered AS (SELECT key, seq, kind, coalesce(nullif(code, ''), 'unknown') AS code, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM {source})",
        f"""states AS (SELECT e.key, e.seq, e.kind, e.n, {first} FROM numbered e, (SELECT {', '.join(f'{x} AS {n}' for n, x in FIRST.items())}) f WHERE e.n = 1
 UNION ALL SELECT e.key, e.seq, e.kind, e.n, {after} FROM states w JOIN numbered e ON e.key = w.key AND e.n = w.n + 1)""",
    ]
