"""Row expressions as SQL text that Spark and other SQL engines read alike, applied in named steps."""

from __future__ import annotations

from pyspark.sql import DataFrame

from karakuri.plans import dims

Step = dict[str, str]
_WHITE = f"[{dims.WHITE}]"


def literals(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def compare_form(raw: str) -> str:
    """Without white space, half-width, upper case, hiragana as katakana."""
    bare = f"translate({display_form(raw)}, '{dims.WIDE}', '{dims.NARROW}')"
    return f"translate(upper(replace({bare}, 'ß', 'SS')), '{dims.HIRAGANA}', '{dims.KATAKANA}')"


def display_form(raw: str) -> str:
    """Without white space; else as it was said."""
    return f"translate({raw}, '{dims.WHITE}', '')"


def first_contained(text: str, aliases) -> str:
    """The first of the ranked aliases that the text contains."""
    return "CASE " + " ".join(f"WHEN contains({text}, '{a}') THEN '{a}'" for _, _, a, _ in aliases) + " END"


def value_of(alias: str, aliases) -> str:
    return "CASE " + " ".join(f"WHEN {alias} = '{a}' THEN '{v}'" for _, v, a, _ in aliases) + " END"


def without(target: str, text: str, needle: str) -> str:
    """target less the characters where the needle first stands in text; unchanged if it is null or not there."""
    at = f"instr({text}, {needle})"
    return f"CASE WHEN {needle} IS NULL OR {at} = 0 THEN {target} ELSE concat(substring({target}, 1, {at} - 1), substring({target}, {at} + length({needle}))) END"


def trimmed(text: str, extra: str = "") -> str:
    """Without white space, and the extra characters, at either end; null if nothing is left."""
    group = f"[{extra}{dims.WHITE}]+"
    return f"nullif(regexp_replace(regexp_replace({text}, '^{group}', ''), '{group}$', ''), '')"


def note_of(text: str) -> str:
    return trimmed(text, "、,。")


def matched(text: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def number_text(x: str) -> str:
    """A number as it is shown: whole ones without a fraction, others with ten digits of it at most and never an exponent."""
    return f"CASE WHEN {x} = floor({x}) THEN cast(cast({x} AS bigint) AS string) ELSE regexp_replace(cast(cast({x} AS decimal(38, 10)) AS string), '[.]?0+$', '') END"


AXES = ("fr", "lr", "io")
MEASURE = "([0-9]+([.][0-9]+)?)(MM|ミリ)"


def position_steps(p: str, c: str, d: str) -> list[Step]:
    """Position words anywhere: {p}_fr, {p}_lr, {p}_io, and the remaining texts {p}_c, {p}_d."""
    steps: list[Step] = []
    for axis in AXES:
        found = f"{p}_{axis}w"
        steps.append({found: first_contained(c, dims.RANKED_POSITIONS[axis])})
        steps.append({f"{p}_{axis}": value_of(found, dims.RANKED_POSITIONS[axis]), f"{p}_c{axis}": without(c, c, found), f"{p}_d{axis}": without(d, c, found)})
        c, d = f"{p}_c{axis}", f"{p}_d{axis}"
    return [*steps, {f"{p}_c": c, f"{p}_d": d}]


def peel_steps(p: str, text: str, side: str) -> list[Step]:
    """Position words off one end (side: right or left), one an axis: {p}_fr, {p}_lr, {p}_io, {p}_n characters."""
    steps: list[Step] = [{f"{p}_t0": text, **{f"{p}_{a}0": "cast(NULL AS string)" for a in AXES}}]
    for k in (1, 2, 3):
        t, now = f"{p}_t{k - 1}", f"{p}_m{k}"
        arms = [f"WHEN {p}_{a}{k - 1} IS NULL AND {side}({t}, {n}) = '{alias}' THEN '{alias}'" for a in AXES for _, _, alias, n in dims.RANKED_POSITIONS[a]]
        steps.append({now: "CASE " + " ".join(arms) + " END"})
        rest = f"left({t}, length({t}) - length({now}))" if side == "right" else f"substring({t}, length({now}) + 1)"
        steps.append({f"{p}_t{k}": f"CASE WHEN {now} IS NULL THEN {t} ELSE {rest} END", **{f"{p}_{a}{k}": f"coalesce({p}_{a}{k - 1}, {value_of(now, dims.RANKED_POSITIONS[a])})" for a in AXES}})
    return [*steps, {f"{p}_n": f"length({text}) - length({p}_t3)", **{f"{p}_{a}": f"{p}_{a}3" for a in AXES}}]


def measure_steps(p: str, c: str, d: str) -> list[Step]:
    """The first measurement: {p}_value, and the remaining texts {p}_c, {p}_d."""
    return [
        {f"{p}_w": matched(c, MEASURE)},
        {f"{p}_value": f"cast({matched(c, MEASURE, 1)} AS double)", f"{p}_c": without(c, c, f"{p}_w"), f"{p}_d": without(d, c, f"{p}_w")},
    ]


def judgement_steps(p: str, c: str, d: str) -> list[Step]:
    """The judgement: {p}_w, {p}_status, and the remaining texts {p}_c, {p}_d."""
    return [
        {f"{p}_w": first_contained(c, dims.RANKED_JUDGEMENTS)},
        {f"{p}_status": value_of(f"{p}_w", dims.RANKED_JUDGEMENTS), f"{p}_c": without(c, c, f"{p}_w"), f"{p}_d": without(d, c, f"{p}_w")},
    ]


def applied(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = df.selectExpr("*", *(f"{expr} AS {name}" for name, expr in step.items()))
    return df


def as_ctes(source: str, prefix: str, steps: list[Step]) -> tuple[list[str], str]:
    """The same steps as common table expressions after a table: (expressions, name of the last)."""
    out = []
    for k, step in enumerate(steps):
        name = f"{prefix}{k}"
        out.append(f"{name} AS (SELECT *, {', '.join(f'{expr} AS {n}' for n, expr in step.items())} FROM {source})")
        source = name
    return out, source
