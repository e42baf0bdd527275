"""Utterances to records: segments by token, their attributes, approximate and unmatched segments, the best candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.functions import portable as P
from karakuri.operators.tokens import approx_match, merged, tokens_of
from karakuri.plans import dims

#: Columns of a parse after the columns that name its utterance.
PARSE = ["ord", "matched", "item_id", "match_type", "status", "front_rear", "left_right", "inner_outer", "value", "co", "hc", "note", "custom_name"]

_LAMPS = P.literals(dims.folded(a) for a in dims.DESCRIPTIVE)


def segment_steps() -> list[P.Step]:
    """Attributes of one token's segment, from (compare, display, k, n_tok, start, stop, prev_stop, next_start, item_id, alias, match_type)."""
    steps: list[P.Step] = [
        {
            "gap_c": "substring(compare, prev_stop + 1, start - prev_stop)", "gap_d": "substring(display, prev_stop + 1, start - prev_stop)",
            "own_c": "substring(compare, stop + 1, next_start - stop)", "own_d": "substring(display, stop + 1, next_start - stop)",
            "span_c": "substring(compare, start + 1, next_start - start)", "span_d": "substring(display, start + 1, next_start - start)",
        },
        *P.peel_steps("lead", "gap_c", "right"),
        *P.peel_steps("next", "own_c", "right"),
        # Position words before the next item are the next item's; after the last item all stays.
        {"lead_raw": "CASE WHEN lead_n > 0 THEN right(gap_d, lead_n) ELSE '' END", "cut_n": "CASE WHEN k + 1 < n_tok THEN length(own_c) - next_n ELSE greatest(length(own_c), length(own_d)) END"},
        {"text_c": "left(own_c, cut_n)", "text_d": "left(own_d, cut_n)"},
        # Exhaust readings: both numbers are looked for in the whole span.
        {"co_w": P.matched("span_c", "CO([0-9]+([.][0-9]+)?)"), "hc_w": P.matched("span_c", "HC([0-9]+([.][0-9]+)?)")},
        {"gas": "item_id = 'co_hc' AND (co_w IS NOT NULL OR hc_w IS NOT NULL)", "gas_c1": P.without("span_c", "span_c", "co_w"), "gas_d1": P.without("span_d", "span_c", "co_w")},
        {"gas_c2": P.without("gas_c1", "gas_c1", "hc_w"), "gas_d2": P.without("gas_d1", "gas_c1", "hc_w")},
        *P.judgement_steps("gas", "gas_c2", "gas_d2"),
        # Lamps and wiring: everything that was said stays in the note.
        *P.judgement_steps("lamp", "text_c", "text_d"),
        # Any other item: position, measurement, judgement, and what is left.
        *P.position_steps("pos", "text_c", "text_d"),
        *P.measure_steps("mes", "pos_c", "pos_d"),
        *P.judgement_steps("jud", "mes_c", "mes_d"),
        {"branch": "CASE WHEN gas THEN 'gas' WHEN item_id = 'electrical' THEN 'lamp' ELSE 'item' END"},
    ]
    item = "branch = 'item'"
    final = {
        "o_type": "CASE WHEN gas THEN 'exact' ELSE match_type END",
        "o_status": "CASE branch WHEN 'gas' THEN gas_status WHEN 'lamp' THEN lamp_status ELSE jud_status END",
        **{f"o_{a}": f"CASE WHEN {item} THEN coalesce(pos_{a}, lead_{a}) END" for a in P.AXES},
        "o_value": f"CASE WHEN {item} THEN mes_value END",
        "o_co": f"CASE WHEN gas THEN cast({P.matched('span_c', 'CO([0-9]+([.][0-9]+)?)', 1)} AS double) END",
        "o_hc": f"CASE WHEN gas THEN cast({P.matched('span_c', 'HC([0-9]+([.][0-9]+)?)', 1)} AS double) END",
        "o_note": f"CASE branch WHEN 'gas' THEN {P.note_of('gas_d')} WHEN 'lamp' THEN {P.note_of(f'concat(lead_raw, CASE WHEN alias IN ({_LAMPS}) THEN alias ELSE {chr(39) * 2} END, lamp_d)')} ELSE {P.note_of('jud_d')} END",
    }
    return [*steps, final]


def whole_steps() -> list[P.Step]:
    """Attributes of an utterance without tokens, from (compare, display): for an approximate item, and for an unmatched name."""
    return [
        *P.peel_steps("head", "compare", "left"),
        {"rest_c": "substring(compare, head_n + 1)", "rest_d": "substring(display, head_n + 1)"},
        *P.position_steps("pos", "rest_c", "rest_d"),
        *P.measure_steps("mes", "pos_c", "pos_d"),
        *P.judgement_steps("jud", "mes_c", "mes_d"),
        *P.judgement_steps("all", "compare", "display"),
    ]


_SEGMENT = "k AS ord, true AS matched, item_id, o_type AS match_type, o_status AS status, o_fr AS front_rear, o_lr AS left_right, o_io AS inner_outer, o_value AS value, o_co AS co, o_hc AS hc, o_note AS note, cast(NULL AS string) AS custom_name"
_WHOLE = f"""0 AS ord, item_id IS NOT NULL AS matched, item_id, CASE WHEN item_id IS NOT NULL THEN 'approx' END AS match_type,
 CASE WHEN item_id IS NOT NULL THEN jud_status ELSE all_status END AS status,
 CASE WHEN item_id IS NOT NULL THEN coalesce(pos_fr, head_fr) END AS front_rear, CASE WHEN item_id IS NOT NULL THEN coalesce(pos_lr, head_lr) END AS left_right,
 CASE WHEN item_id IS NOT NULL THEN coalesce(pos_io, head_io) END AS inner_outer, CASE WHEN item_id IS NOT NULL THEN mes_value END AS value,
 cast(NULL AS double) AS co, cast(NULL AS double) AS hc, cast(NULL AS string) AS note, CASE WHEN item_id IS NULL THEN coalesce({P.note_of('all_d')}, all_d) END AS custom_name"""


def aligned(utterances: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds compare and display, the folded and the shown form; a null utterance counts as empty."""
    said = F.coalesce(F.col(raw), F.lit(""))
    return utterances.withColumn("_raw", said).withColumns({"compare": F.expr(P.compare_form("_raw")), "display": F.expr(P.display_form("_raw"))}).drop("_raw")


def with_tokens(utterances: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds compare, display and the merged tokens. Equal texts are matched against the dictionary once."""
    said = aligned(utterances, raw)
    found = tokens_of(said.select("compare"))
    return said.join(found.select("compare", merged(F.col("tokens")).alias("tokens")), "compare", "left")


def segments(tokenised: DataFrame, *keys: str) -> DataFrame:
    """One row for each token with the bounds of its neighbours."""
    bounds = F.transform("tokens", lambda t, k: F.struct(
        k.alias("k"), F.size("tokens").alias("n_tok"), t["start"].alias("start"), t["end"].alias("stop"),
        F.when(k == 0, F.lit(0)).otherwise(F.get("tokens", F.greatest(k - 1, F.lit(0)))["end"]).alias("prev_stop"),
        F.coalesce(F.get("tokens", k + 1)["start"], F.length("compare")).alias("next_start"),
        t["item_id"].alias("item_id"), t["alias"].alias("alias"), t["match_type"].alias("match_type"),
    ))
    return tokenised.select(*keys, "compare", "display", F.explode(bounds).alias("s")).select(*keys, "compare", "display", "s.*")


def parse(utterances: DataFrame, *keys: str, raw: str = "raw") -> DataFrame:
    """(keys, ord, matched, item_id, ...): every utterance's records in order; at least one for each utterance.

    Equal texts are parsed once; a null one counts as empty. A key with the name of a column of a record comes out as
    key_<name>.
    """
    said = utterances.select(F.struct(*keys).alias("_key"), F.coalesce(F.col(raw), F.lit("")).alias("_said"))
    named = [F.col(f"_key.{k}").alias(f"key_{k}" if k in PARSE else k) for k in keys]
    return said.join(parse_texts(said.select("_said").distinct()), "_said").select(*named, *PARSE)


def parse_texts(texts: DataFrame) -> DataFrame:
    """Distinct texts (_said) -> (_said, ord, matched, item_id, ...)."""
    tokenised = with_tokens(texts, "_said")
    some = _kept(P.applied(segments(tokenised, "_said"), segment_steps()), ["_said"], _SEGMENT)
    none = P.applied(tokenised.where(F.size("tokens") == 0).select("_said", "compare", "display"), whole_steps())
    none = _kept(none.withColumn("item_id", approx_match(F.col("jud_c"))["item_id"]), ["_said"], _WHOLE)
    return some.unionByName(none)


def _kept(steps: DataFrame, keys, columns: str) -> DataFrame:
    """The columns as rows of a generator. A filter on them stays above it; moved below, it would have the optimiser
    write every step into the next, and their number would grow exponentially."""
    return steps.selectExpr(*keys, f"inline_outer(array(struct({columns})))")


def _split(columns: str) -> list[str]:
    """Comma-separated expressions, cut outside brackets and quotes."""
    out, depth, quoted, now = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def choose_best(alternatives: DataFrame, *keys: str) -> DataFrame:
    """(keys, alt, raw, ...): from the alternatives (keys, alternatives: array of texts, best first) the parse of the
    one with the highest score: 10 for a record, 5 more for an exact one, 3 less for an unmatched name; the earlier on ties.

    Texts are trimmed, empty ones and all after the fifth left out; without any there is no record.
    """
    said = F.filter(F.transform(F.slice("alternatives", 1, 5), lambda t: F.regexp_replace(F.regexp_replace(t, f"^[{dims.WHITE}]+", ""), f"[{dims.WHITE}]+$", "")), lambda t: t != "")
    each = alternatives.select(*keys, F.posexplode(said).alias("alt", "raw"))
    parsed = parse(each, *keys, "alt", "raw")
    record = F.struct(*PARSE)
    points = F.when(~F.col("matched"), -3).when(F.col("match_type") == "exact", 15).otherwise(10)
    scored = parsed.groupBy(*keys, "alt", "raw").agg(F.sum(points).alias("score"), F.array_sort(F.collect_list(record)).alias("records"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("alt", "raw", "score", "records"), F.struct("score", -F.col("alt"))).alias("b"))
    return best.select(*keys, "b.alt", "b.raw", "b.score", F.explode("b.records").alias("r")).select(*keys, "alt", "raw", "score", "r.*")


_SIGNS = sorted({c for a in dims.ALIASES for c in a[2]})
_ASCII = [chr(c) for c in (*range(0x21, 0x7E), *range(0x0E, 0x20)) if chr(c) not in "'\\"]


def _plain(text: str) -> str:
    """Every letter of the dictionary as one byte, since the checking engine's distances count bytes."""
    return text.translate(str.maketrans("".join(_SIGNS), "".join(_ASCII[: len(_SIGNS)])))


def _plain_sql(text: str) -> str:
    return f"translate(regexp_replace({text}, '[^{''.join(_SIGNS)}]', '~', 'g'), '{''.join(_SIGNS)}', '{''.join(_ASCII[: len(_SIGNS)])}')"


def parse_ctes(source: str) -> list[str]:
    """The parse of a table (uid, raw) in plain SQL by brute force, for checking: expressions that end in `parses`.

    Every place is compared with every alias, tokens are picked by recursion, and segments found with window functions.
    """
    aliases = dims.values([(*a[:2], _plain(a[2]), a[3], dims.fuzzy_limit(a[3]), a[2]) for a in dims.ALIASES], "rank, item_id, plain, n, d, alias")
    edits = dims.values([(r, i, _plain(a), dims.approx_limit(n)) for r, i, a, n in dims.ALIASES if dims.approx_limit(n)], "rank, item_id, plain, most")
    segment, last = P.as_ctes("seg", "g", segment_steps())
    whole, end = P.as_ctes("bare", "w", whole_steps())
    return [
        f"said AS (SELECT uid, {P.compare_form('raw')} AS compare, {P.display_form('raw')} AS display FROM {source})",
        "texts AS (SELECT DISTINCT compare FROM said WHERE length(compare) > 0)",
        f"places AS (SELECT compare, {_plain_sql('compare')} AS plain, unnest(range(length(compare)))::INT AS start FROM texts)",
        f"near AS (SELECT compare, start, rank, item_id, n, CASE WHEN start + n <= length(compare) THEN hamming(substring(p.plain, start + 1, n), a.plain) END AS off, d FROM places p JOIN {aliases} a ON start + n <= length(compare))",
        """picked AS (SELECT compare, start, coalesce(min(CASE WHEN off = 0 THEN rank END), CASE WHEN count(DISTINCT CASE WHEN off > 0 THEN item_id END) = 1 THEN min(CASE WHEN off > 0 THEN rank END) END) AS rank,
 count(CASE WHEN off = 0 THEN 1 END) > 0 AS exact FROM near WHERE off = 0 OR (off <= d AND n >= 3) GROUP BY compare, start)""",
        f"cand AS (SELECT compare, start, start + n AS stop, item_id, alias, CASE WHEN exact THEN 'exact' ELSE 'fuzzy' END AS match_type FROM picked JOIN {aliases} USING (rank))",
        """walk AS (SELECT compare, min(start) AS start FROM cand GROUP BY compare UNION ALL
 SELECT c.compare, (SELECT min(x.start) FROM cand x WHERE x.compare = c.compare AND x.start >= c.stop) FROM walk w JOIN cand c ON c.compare = w.compare AND c.start = w.start WHERE w.start IS NOT NULL)""",
        "toks AS (SELECT cand.* FROM walk JOIN cand USING (compare, start))",
        "firsts AS (SELECT * FROM (SELECT *, lag(item_id) OVER (PARTITION BY compare ORDER BY start) AS before FROM toks) WHERE before IS NULL OR before <> item_id)",
        """bounds AS (SELECT *, (row_number() OVER w - 1)::INT AS k, (count(*) OVER (PARTITION BY compare))::INT AS n_tok, coalesce(lag(stop) OVER w, 0) AS prev_stop, coalesce(lead(start) OVER w, length(compare)) AS next_start
 FROM firsts WINDOW w AS (PARTITION BY compare ORDER BY start))""",
        "seg AS (SELECT uid, display, bounds.* EXCLUDE (before) FROM said JOIN bounds USING (compare))",
        *segment,
        "bare AS (SELECT * FROM said ANTI JOIN toks USING (compare))",
        *whole,
        f"""edits AS (SELECT jud_c, item_id, min(levenshtein({_plain_sql('jud_c')}, plain)) AS e FROM (SELECT DISTINCT jud_c FROM {end} WHERE jud_c <> '') JOIN {edits} a
 ON levenshtein({_plain_sql('jud_c')}, plain) BETWEEN 1 AND most GROUP BY jud_c, item_id)""",
        "approx AS (SELECT jud_c, min_by(item_id, e) AS item_id FROM (SELECT *, min(e) OVER (PARTITION BY jud_c) AS low FROM edits) WHERE e = low GROUP BY jud_c HAVING count(*) = 1)",
        f"parses AS (SELECT uid, {_SEGMENT} FROM {last} UNION ALL SELECT uid, {_WHOLE} FROM {end} LEFT JOIN approx USING (jud_c))",
    ]
