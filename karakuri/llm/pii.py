"""Personal data: exact patterns, then a skip-chain conditional random field with loopy message passing."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import table

#: Kinds in the order in which spans with the same start are listed; the last comes from the field alone.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)
ROUNDS, DAMPING, LEAST_BELIEF = 12, 0.3, 0.6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # starts inside a run of digits match only where its start does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")
ASSIGNED = re.compile(r"(?:token|password|passwd|pwd|secret|key|apikey|api_key|bearer|auth|credentials?)[\"']?[\x20]?[=:]", re.I)
# Words that announce personal data.
CUES = {
    "secret": set("token password passwd pwd secret key apikey api_key bearer auth credential credentials".split()),
    "card": set("card visa mastercard credit debit amex".split()),
    "phone": set("phone tel telephone call mobile cell fax".split()),
    "ip": set("ip host server address addr".split()),
    "email": set("email e-mail mail mailto contact".split()),
}


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the exact patterns, by start and then kind; offsets are code points, the end exclusive."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, "email", m.end()))
        after = m.end() if m else at + 1
        at = text.find("@", after)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def core_of(word: str) -> tuple[int, int]:
    """Where a word's inner part starts and ends: without quotes, brackets and punctuation around it."""
    start, end = 0, len(word)
    while start < end and not (word[start].isalnum() or word[start] == "+"):
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return start, end


def _features(word: str, before: list[str], after: str) -> list[str]:
    """Names of the observations at a word; before: the words before it, the nearest first."""
    a, b = core_of(word)
    core = word[a:b]
    digits = re.sub("[^0-9]", "", core)
    letters = sum(c.isalpha() for c in core)
    n = len(digits)
    out = ["bias", f"digits{min(n, 20) // 4}", f"dots{min(core.count('.'), 4)}"]
    out += ["at"] if "@" in core else []
    out += ["plus"] if core[:1] == "+" else []
    out += ["brackets"] if "(" in word and ")" in word else []
    out += ["dash"] if re.fullmatch(r"[0-9]+(?:-[0-9]+)+", core) else []
    out += ["all_digits"] if n and n == len(core) else []
    out += ["mixed"] if letters and n else []
    out += ["luhn"] if letters == 0 and 12 <= n <= 19 and luhn(digits) else []
    out += ["card_like"] if letters == 0 and 12 <= n <= 19 and not luhn(digits) else []
    out += ["long_hex"] if len(core) >= 20 and n >= 3 and re.fullmatch("[0-9A-Fa-f]+", core) else []
    out += ["long_mixed"] if len(core) >= 16 and n >= 3 and letters >= 3 and re.fullmatch("[0-9A-Za-z_+/=-]+", core) else []
    out += ["quoted"] if word[:1] in "\"'`" else []
    out += [f"letters{min(len(core), 15) // 4}"] if core and not n and "@" not in core else []
    quad = core.split(".")
    out += ["quad"] if len(quad) == 4 and all(q.isascii() and q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quad) else []
    if any(w in "=:" or w[-1] in "=:" for w in before[:1]):
        out.append("assigned")
        before = before[1:] if before[0] in "=:" else before
    for name, cues in CUES.items():
        if any(re.sub("[^a-z0-9_-]", "", w.lower()) in cues for w in before[:2]):
            out.append(f"cue_{name}")
    return out


def graph(text: str) -> tuple[list[tuple[int, int]], list[list[str]], list[tuple[int, int]], list[tuple[int, int]]]:
    """The field of one document: its nodes, as spans of their inner part, their observations, chain edges between
    neighbours in the text, and skip edges between repeated or similar words.

    Nodes are the words with a digit or @, the words that are assigned to a word that announces a secret, and every
    other place of these.
    """
    assigned = ("=" in text or ":" in text) and ASSIGNED.search(text)
    if "@" not in text and not assigned and not DIGIT.search(text):
        return [], [], [], []
    matches = list(WORD.finditer(text))
    chosen = [k for k, m in enumerate(matches) if "@" in m[0] or DIGIT.search(m[0])]
    if assigned:
        ends = [m.end() for m in ASSIGNED.finditer(text)]
        starts = [m.start() for m in matches]
        values = {bisect_left(starts, e) for e in ends} - {len(matches)} - set(chosen)
        inner = lambda k: matches[k][0][slice(*core_of(matches[k][0]))].casefold()
        said = {inner(k) for k in values} - {""}
        chosen = sorted({*chosen, *(k for k in range(len(matches)) if inner(k) in said)}) if said else chosen
    nodes, seen, chain, skip, last = [], [], [], [], {}
    for j, k in enumerate(chosen):
        word = matches[k][0]
        a, b = core_of(word)
        nodes.append((matches[k].start() + a, matches[k].start() + b))
        seen.append(_features(word, [matches[x][0] for x in range(k - 1, max(k - 4, -1), -1)], matches[k + 1][0] if k + 1 < len(matches) else ""))
        if j and chosen[j - 1] == k - 1:
            chain.append((j - 1, j))
        core = word[a:b].casefold()
        digits = re.sub("[^0-9]", "", core)
        for form in {core, digits if len(digits) >= 6 else core}:
            if form in last and last[form] != j - 1 and form:
                skip.append((last[form], j))
            last[form] = j
    return nodes, seen, chain, sorted(set(skip))


def labelled_texts(n: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Invented remarks with the label of each word: the table that the field is fitted on, made by a rule."""
    r = random.Random(seed)
    filler = "the a note of it was then and so on with more for this about there from some line item part".split()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid):
        while luhn(x := r.choice("456") + digits(15)) != valid:
            pass
        return x

    def make(kind):
        if kind == "email":
            return [f"{r.choice(filler)}{r.choice(['.', '_', ''])}{digits(2)}@{r.choice(['mail', 'post'])}{digits(1)}.example.{r.choice(['com', 'org'])}"]
        if kind == "ip":
            return [".".join(str(r.randrange(1, 256)) for _ in range(4))]
        if kind == "card":
            return [card(True)]
        if kind == "phone":
            return [f"+{r.randrange(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]
        if kind == "secret" and r.random() < 0.3:
            return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(r.randrange(8, 16)))]
        if kind == "secret":
            return ['"' + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))) + '"']
        return [r.choice([digits(4), digits(2), f"{digits(1)}.0.", f"{digits(1)},{digits(3)}", f"20{digits(2)}-0{r.randrange(1, 9)}-1{digits(1)}", card(False), f"A{digits(2)}", digits(7), f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)}-{digits(3)}"])]

    out = []
    for _ in range(n):
        words, labels = [], []

        def say(ws, label):
            words.extend(ws)
            labels.extend([label] * len(ws))

        kind = r.choice(LABELS)
        value = make(kind)
        for again in range(r.choice((1, 1, 2, 3))):
            say([r.choice(filler) for _ in range(r.randrange(2, 6))], "none")
            cue = kind in CUES and (value[0].isalpha() and not again or r.random() < (0.9 if kind == "secret" and not again else 0.2))
            if cue:
                say([r.choice(sorted(CUES[kind]))], "none")
                say(["="] if kind == "secret" else [], "none")
            say([v + (r.choice(["", "", ".", ",", "!!"]) if v is value[-1] else "") for v in value], kind)
            if r.random() < 0.4:
                say([r.choice(filler), *make("none")], "none")
            if r.random() < 0.15:
                say([r.choice(["token", "password", "key"]), r.choice(["=", ":"]), r.choice(filler)], "none")
        say([r.choice(filler)], "none")
        out.append((" ".join(words), labels))
    return out


@lru_cache(1)
def fitted() -> tuple[dict[str, int], list, list, list]:
    """(index of observations, weights, chain potentials, skip potentials), fitted by regularised pseudo-likelihood."""
    import numpy as np

    names: dict[str, int] = {}
    rows, y, chain, skip = [], [], [], []
    for text, labels in labelled_texts():
        nodes, seen, c, s = graph(text)
        words = [m.span() for m in WORD.finditer(text)]
        own = [next(labels[k] for k, w in enumerate(words) if w[0] <= a < w[1]) for a, _ in nodes]
        chain += [(a + len(rows), b + len(rows)) for a, b in c]
        skip += [(a + len(rows), b + len(rows)) for a, b in s]
        for f in seen:
            rows.append([names.setdefault(x, len(names)) for x in f])
        y += [LABELS.index(x) for x in own]
    x, n, k = np.zeros((len(rows), len(names))), len(rows), len(LABELS)
    for i, f in enumerate(rows):
        x[i, f] = 1
    y = np.array(y)
    one = np.eye(k)[y]
    c, s = (np.array(e, int).reshape(-1, 2) for e in (chain, skip))
    w, t, u = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros((k, k))
    for _ in range(400):
        z = x @ w
        np.add.at(z, c[:, 1], t[y[c[:, 0]]])
        np.add.at(z, c[:, 0], t[:, y[c[:, 1]]].T)
        np.add.at(z, s[:, 1], u[y[s[:, 0]]])
        np.add.at(z, s[:, 0], u[y[s[:, 1]]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = one - p / p.sum(axis=1, keepdims=True)
        gt, gu = np.zeros((k, k)), np.zeros((k, k))
        np.add.at(gt, y[c[:, 0]], g[c[:, 1]])
        np.add.at(gt.T, y[c[:, 1]], g[c[:, 0]])
        np.add.at(gu, y[s[:, 0]], g[s[:, 1]])
        np.add.at(gu, y[s[:, 1]], g[s[:, 0]])
        w += 3.0 * (x.T @ g / n - 0.0005 * w)
        t += 3.0 * (gt / n - 0.0005 * t)
        u += 1.5 * ((gu + gu.T) / n - 0.001 * u)
    return names, w.tolist(), t.tolist(), u.tolist()


def beliefs(seen, chain, skip, model):
    """Marginals of every node by loopy sum-product message passing over chain and skip edges."""
    import numpy as np

    names, w, t, u = model[0], *(np.asarray(m) for m in model[1:])
    k, n = len(LABELS), len(seen)
    score = np.array([w[[names[f] for f in row if f in names]].sum(axis=0) for row in seen]).reshape(n, k)
    edges = [(a, b, t) for a, b in chain] + [(a, b, u) for a, b in skip]
    if not edges:
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    e = len(edges)
    src = np.array([a for a, _, _ in edges] + [b for _, b, _ in edges])
    dst = np.concatenate((src[e:], src[:e]))
    pot = np.array([m for *_, m in edges] + [m.T for *_, m in edges])
    back = np.concatenate((np.arange(e, 2 * e), np.arange(e)))
    msg = np.zeros((2 * e, k))
    for _ in range(ROUNDS):
        total = score.copy()
        np.add.at(total, dst, msg)
        inside = (total[src] - msg[back])[:, :, None] + pot
        top = inside.max(axis=1)
        new = top + np.log(np.exp(inside - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        msg = DAMPING * msg + (1 - DAMPING) * new
    total = score.copy()
    np.add.at(total, dst, msg)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def field_spans(text: str, model) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the field labels; neighbours in the text with the same label are one span."""
    nodes, seen, chain, skip = graph(text)
    if not nodes:
        return []
    p = beliefs(seen, chain, skip, model)
    linked = {b: a for a, b in chain}
    out: list[tuple[int, str, int]] = []
    last, before = None, 0
    for j, (start, end) in enumerate(nodes):
        best = int(p[j].argmax())
        if best == 0 or p[j][best] < LEAST_BELIEF or start == end:
            continue
        if last == linked.get(j, -1) and before == best and best in (3, 4):
            out[-1] = (out[-1][0], LABELS[best], end)
        else:
            out.append((start, LABELS[best], end))
        last, before = j, best
    return out


def all_spans(text: str, model) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and base spans with those of the field that overlap none of them."""
    base = base_spans(text)
    more = [s for s in field_spans(text, model) if not any(s[0] < b[2] and b[0] < s[2] for b in base)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


SPAN = "array<struct<start: bigint, kind: string, `end`: bigint>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id_col, *keep, base, spans): personal data of every whole text as arrays of (start, kind, end).

    base: the exact patterns; spans: these and what the field adds. The field is fitted when the operator is called. A
    null text counts as empty and has empty arrays; rows with null or repeated ids are each searched, texts of any length
    whole; columns named base or spans are no part of the result unless kept under other names; an empty table gives an
    empty result.
    """
    import pyarrow as pa

    model = fitted()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    names = [id_col, *keep]

    def run(batches):
        for batch in batches:
            found = [all_spans(t.as_py() or "", model) for t in batch.column(0)]
            arrays = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in row[k]] for row in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*names, "base", "spans"])

    schema = docs.select(*names, F.lit(None).cast(SPAN).alias("base"), F.lit(None).cast(SPAN).alias("spans")).schema
    return docs.select(F.col(text_col).cast("string").alias("_text"), *names).mapInArrow(run, schema)


def _listed(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind in angle brackets; overlapping spans by that of the first. n_chars, if there is
    one, follows. Null texts stay null, rows with null or repeated ids are each redacted, an empty table stays empty,
    columns keep their names and order."""
    import pyarrow as pa

    model, names = fitted(), docs.columns
    at = names.index("text")

    def redact(text):
        out, after = [], 0
        for start, kind, end in all_spans(text, model)[1]:
            if start >= after:
                out += [text[after:start], f"<{kind.upper()}>"]
            after = max(after, end)
        return "".join([*out, text[after:]])

    def run(batches):
        for batch in batches:
            texts = pa.array([t if t is None else redact(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out
