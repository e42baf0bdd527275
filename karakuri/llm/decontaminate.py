"""Benchmark decontamination: canonical templates, a hash join of their windows, and a check that slots agree."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karakuri.llm.common import cut, table

#: Canonical tokens per window, and how many of them must be plain words.
WINDOW, PLAIN = 8, 4
#: Items without such a window are looked for word by word; with fewer words than this only as a whole text.
LEAST_WORDS = 4
#: A document is contaminated by an item if slot-consistent windows cover so much of the item's windows, or if they
#: are as many as a run of RUN words has.
COVERAGE, RUN = 0.5, 13
#: Windows of one item count together if their alignments differ by so many tokens at most.
SPAN = 8
#: The item windows are broadcast up to this many; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 500_000

# Units, words that number things, and words that are no names though a sentence may begin with them.
UNITS = "mm cm m km in inch inches ft foot feet mile miles yd mg g kg lb lbs oz ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kj cal kcal kpa percent dollar dollars euro euros cent cents usd eur"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
COMMON = "a an the this that these those he she it we you they i his her its our your their my who what when where which why how if in on at of to for from by with and or but not no so as is are was were be been has have had do does did can could will would shall should may might must there then than after before while during each every all some any both find calculate compute determine given let suppose assume consider"

#: The hashes that placeholders have; a word's hash is as good as never one of them.
NUM, NAME, UNIT = 1, 2, 3
#: Between words: what is neither letter nor digit, but for one point, comma, colon, slash or hyphen inside a number.
BETWEEN = r"(?:[^\p{L}\p{N}](?<![0-9][.,:/-](?=[0-9])))+"


def _is_number(word: Column) -> Column:
    """Words that start below "a" start with a digit, if not with a letter of another script's upper case."""
    return F.when(word < "a", word.rlike("^[0-9]+(?:[.,:/-][0-9]+)*$")).otherwise(word.isin(NUMBERS.split()))


def _words(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds _w (words), _l (in lower case) and _r (their hashes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = rows.withColumn("_w", F.filter(F.split(text, BETWEEN), lambda w: w != "")).withColumn("_l", F.transform("_w", F.lower))
    return out.withColumn("_r", F.transform("_l", lambda w: F.xxhash64(w)))


def _forms(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds _a (hashes of the words, with numbers and units as placeholders) and _b (with capitalised words as names, too)
    to _words. A unit is one only after a number."""
    unit = lambda w, i: w.isin(UNITS.split()) & F.coalesce(_is_number(F.get("_l", i - 1)), F.lit(False))
    out = _words(rows, text_col).withColumn("_a", F.transform("_l", lambda w, i: F.when(_is_number(w), F.lit(NUM).cast("long")).when(unit(w, i), F.lit(UNIT).cast("long")).otherwise(F.xxhash64(w))))
    named = lambda x, i: (F.get("_w", i) != F.get("_l", i)) & ~x.isin(NUM, UNIT) & ~F.get("_l", i).isin(COMMON.split())
    return out.withColumn("_b", F.transform("_a", lambda x, i: F.when(named(x, i), F.lit(NAME).cast("long")).otherwise(x)))


def _starts_token(h: str, x: Column, i: Column) -> Column:
    """Whether a word begins a canonical token: all but those in a run of numbers, or of names, after the first."""
    return ~x.isin(NUM, NAME) | F.coalesce(x != F.get(h, i - 1), F.lit(True))


def _canonical(h: str) -> Column:
    return F.filter(h, lambda x, i: _starts_token(h, x, i))


def _begins(h: str) -> Column:
    """Where canonical tokens begin, and the end."""
    return F.filter(F.sequence(F.lit(0), F.size(h)), lambda i: F.coalesce(_starts_token(h, F.get(h, i), i), F.lit(True)))


def _joined(h: str, step: int) -> Column:
    """Each hash joined with the one step places on, alone near the end."""
    return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def _whole(h: str, width: int) -> Column:
    """The hashes of windows that don't reach over the end."""
    return F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))


def _hashes(tokens: str, width: int) -> Column:
    """The hash of every window of so many words as they are, by its first."""
    return F.transform(_whole(tokens, width), lambda x, i: F.xxhash64(F.lit(-width), x, *(F.get(tokens, i + j) for j in range(1, width))))


def _as_they_are(n: int) -> Column:
    """Hashes of the windows of n words as they are; 0: of the whole text."""
    return _hashes("_r", n) if n else F.array(F.xxhash64(F.lit(0), F.array_join("_l", " ")))


def _window_hashes(forms: DataFrame, widths) -> DataFrame:
    """Adds _wa and _wb (hashes of windows of canonical tokens), and _w<n> of n words as they are for each width."""
    forms = forms.withColumns({"_ca": _canonical("_a"), "_cb": _canonical("_b")})
    width, h = 1, "_c"
    while width < WINDOW:
        forms = forms.withColumns({f"_h{2 * width}{f}": _joined(f"{h}{f}", width) for f in "ab"})
        width, h = 2 * width, f"_h{2 * width}"
    return forms.withColumns({**{f"_w{f}": _whole(f"{h}{f}", WINDOW) for f in "ab"}, **{f"_w{n}": _as_they_are(n) for n in widths}})


def _slots(c: str, s: str, i: Column) -> Column:
    """The words behind the placeholders of a window in their places; c: tokens, s: where they begin."""
    words = lambda j: F.array_join(F.slice("_l", F.get(s, j) + 1, F.get(s, j + 1) - F.get(s, j)), " ")
    return F.transform(F.sequence(i, i + (WINDOW - 1)), lambda j: F.when(F.get(c, j).isin(NUM, NAME, UNIT), words(j)))


def _windows(rows: DataFrame, key: str, text_col: str, widths, items: DataFrame | None = None) -> DataFrame:
    """(key, h, i, at, slots, and the columns of items): every window by its first token i and word at, or those that
    items have; slots: the words behind placeholders in their places."""
    forms = _window_hashes(_forms(rows, text_col), widths).withColumns({"_sa": _begins("_a"), "_sb": _begins("_b")})
    out = []
    for f in ("a", "b", *widths):
        held = [key, "_l", F.col(f"_c{f}").alias("_c"), F.col(f"_s{f}").alias("_s")] if f in ("a", "b") else [key]
        each = forms.select(*held, F.transform(f"_w{f}", lambda h, i: F.struct(h.alias("h"), i.alias("i"))).alias("_x"))
        # explode_outer: for explode the optimiser would compute its argument once more, in a filter
        each = each.select("*", F.explode_outer("_x").alias("x")).where("x IS NOT NULL").drop("_x").select("*", "x.h", "x.i").drop("x")
        more = [c for c in items.columns if c != "h"] if items is not None else []
        each = each if items is None else each.join(items, "h")
        at, slots = (F.get("_s", F.col("i")), _slots("_c", "_s", F.col("i"))) if f in ("a", "b") else (F.col("i"), F.lit(None).cast("array<string>"))
        out.append(each.select(key, "h", "i", at.alias("at"), slots.alias("slots"), *more))
    return reduce(DataFrame.unionByName, out)


def _keyed(rows: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """(key, _text): key tells rows apart by id, null included, and text."""
    text = F.col(text_col).cast("string")
    return rows.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")).alias(key), text.alias("_text"))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_at, i, h, width, item_slots, of): the windows of each item; of: in how many places it has one.

    width: 8 canonical tokens (8), or for an item without a window of enough plain words its words as they are (-8), all
    of them if it has fewer (-n); 0 if it has so few that only a whole text can be the item.
    """
    rows = cut(_keyed(benchmark, item_col, text_col, "item").where("_text IS NOT NULL").distinct())
    found = cut(_windows(rows, "item", "_text", ()))
    found = found.where(F.size(F.filter("slots", lambda s: s.isNull())) >= PLAIN).withColumn("width", F.lit(8))
    rest = rows.join(found.select("item").distinct(), "item", "left_anti")
    rest = cut(_words(rest, "_text").where("size(_l) > 0").select("item", "_l", "_r", F.when(F.size("_l") < LEAST_WORDS, 0).otherwise(F.least(F.size("_l"), F.lit(WINDOW))).alias("n")))
    for n in sorted(r["n"] for r in rest.select("n").distinct().collect()):
        raw = rest.where(F.col("n") == n).select("item", F.posexplode(_as_they_are(n)).alias("i", "h"))
        found = found.unionByName(raw.select("item", "h", "i", F.col("i").alias("at"), F.lit(None).cast("array<string>").alias("slots"), F.lit(-n).alias("width")))
    found = cut(found.dropDuplicates(["item", "h", "at", "i"]))
    of = found.groupBy("item").agg(F.countDistinct("at").alias("of"))
    return found.join(of, "item").select("item", F.col("at").alias("item_at"), F.col("i").alias("item_i"), "h", "width", F.col("slots").alias("item_slots"), "of")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """(doc, item, n_windows, of, coverage, reworded): the documents that hold an item, however its slots are filled.

    doc and item are structs (id, h: hash of the text), so rows with equal or null ids are judged each by their own text
    and equal rows once. Texts become words without punctuation; runs of numbers, of capitalised words (unless they are
    common ones) and units after numbers become typed placeholders. Texts are read with and without placeholders for
    names, so an item is found in other letter cases, and with other names, of any number of words. A window of a
    document matches an item's when their canonical tokens are equal. Of the matched windows those count whose slots
    agree: among alignments (token position in the document minus that in the item) within SPAN of each other every
    item value must stand for the same document value throughout, by majority of the windows, and vice versa. coverage:
    the share of the item's windows so found; reworded: whether some slot differs. Items without a window of PLAIN plain
    words (short or symbolic ones) are found where all of their words stand in a row, as they are but for case; those
    under LEAST_WORDS words where they are a whole text. An item without a word is in no document. Null texts have no
    windows; texts of any length are read whole; other columns are ignored; empty tables give an empty result.
    """
    items = cut(item_windows(benchmark, item_col, text_col))
    number = items.count()
    widths = [-r["width"] for r in items.select("width").distinct().collect() if r["width"] <= 0]
    if number <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    rows = _keyed(docs, id_col, text_col, "doc")
    hashes = _window_hashes(_forms(rows, "_text"), widths)
    each = hashes.select("doc", "_text", F.concat(*(f"_w{f}" for f in ("a", "b", *widths))).alias("_x")).select("doc", "_text", F.explode_outer("_x").alias("h"))
    wanted = items.select("h").distinct()
    rows = cut(each.join(F.broadcast(wanted) if number <= BROADCAST_WINDOWS else wanted, "h", "left_semi").select("doc", "_text").distinct())  # texts with some window
    shift = F.floor((F.col("i") - F.col("item_i")) / SPAN)
    hit = cut(
        _windows(rows, "doc", "_text", widths, items)
        .select("doc", "item", "of", "item_at", F.explode(F.array(shift - 1, shift)).alias("place"), "item_slots", "slots")
    )
    group = ["doc", "item", "place"]
    pairs = (
        hit.select(*group, F.explode(F.arrays_zip("item_slots", "slots")).alias("z"))
        .where("z.item_slots IS NOT NULL AND z.slots IS NOT NULL")
        .groupBy(*group, F.col("z.item_slots").alias("theirs"), F.col("z.slots").alias("ours"))
        .agg(F.count("*").alias("n"))
    )
    # One document value for each item value and one item value for each document value: those seen most.
    most = lambda key: F.row_number().over(Window.partitionBy(*group, key).orderBy(F.desc("n"), "theirs", "ours"))
    bad = pairs.withColumns({"_a": most("theirs"), "_b": most("ours")}).where("_a > 1 OR _b > 1").groupBy(*group).agg(F.collect_set(F.struct("theirs", "ours")).alias("bad"))
    zipped = F.arrays_zip("item_slots", "slots")
    clash = F.exists(zipped, lambda z: F.exists("bad", lambda b: b["theirs"].eqNullSafe(z["item_slots"]) & b["ours"].eqNullSafe(z["slots"])))
    agreed = hit.join(bad, group, "left").where(F.col("bad").isNull() | ~F.coalesce(clash, F.lit(False)))
    differs = F.exists(zipped, lambda z: ~z["item_slots"].eqNullSafe(z["slots"]))
    placed = agreed.groupBy(*group, "of").agg(F.countDistinct("item_at").alias("n"), F.max(F.coalesce(differs, F.lit(False))).alias("reworded"))
    best = placed.groupBy("doc", "item", "of").agg(F.max(F.struct("n", F.col("reworded"))).alias("b"))
    return (
        best.select("doc", "item", F.col("b.n").alias("n_windows"), "of", (F.col("b.n") / F.col("of")).alias("coverage"), F.col("b.reworded").alias("reworded"))
        .where((F.col("coverage") >= coverage) | (F.col("n_windows") > run - WINDOW))
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id"), "n_windows", F.round("coverage", 6).alias("coverage"), "reworded")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, by their own text: repeated ids and null ids make no difference. The others
    stay as they are, repeated rows and null texts among them; an empty table stays empty; columns keep names and order."""
    leaked = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")).alias("doc"))
    return rows.join(leaked, "doc", "left_anti").select("_doc.*")
