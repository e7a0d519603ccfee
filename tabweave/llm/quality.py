"""Quality rules by distribution divergence, in SQL expressions only.

A document has two histograms: its characters by class, and its words by the common words of its language (and the rest).
Each is compared with the reference of the language by Jensen-Shannon distance (base 2, from 0 to 1), where the
text is long enough for a histogram to mean something. References are medians over all documents of the language, so junk
in less than half of them doesn't move them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CHARS = 200
LEAST_WORDS = 100
MOST_CLASS_DISTANCE = 0.205
MOST_WORD_DISTANCE = 0.31
LEAST_BASE_WORDS = 50
MOST_REPEATED_PERCENT = 50

# fixed values: common function words of each language
COMMON = {
    "en": "the of and to in a is that it for was on are with as be at this by from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
CLASSES = ("lower", "upper", "number", "space", "mark", "symbol", "other")
#: A language is a code of two or three letters, with or without a region; so there are at most 26^2 + 26^3 languages.
_LANGUAGE = r"^([a-z]{2,3})(?:[-_].*)?$"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
_MARK = r"""[.,;:!?'"()\-]"""
_CODES = "abcdefghijklmnopqrstuvwxyz"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _histograms(docs: DataFrame) -> DataFrame:
    """``row`` (the columns of docs), text, rest (without lower-case letters), words, language, classes and common (counts)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = rows.select("row", text.alias("text"))
    rows = rows.select("*", F.regexp_replace("text", r"\p{Ll}+", "").alias("rest"), F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"))
    frequent = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*sorted({w for ws in COMMON.values() for w in ws})))
    rows = rows.select("*", frequent.alias("frequent"))
    own = F.nullif(F.regexp_extract(F.lower(F.col("row.lang").cast("string")), _LANGUAGE, 1), F.lit(""))
    hits = [F.struct(_among("frequent", ws).alias("n"), F.lit(lang).alias("lang")) for lang, ws in sorted(COMMON.items())]
    guess = F.array_max(F.array(*hits))["lang"]
    rows = rows.select("*", F.coalesce(own, guess).alias("language"))
    counted = [_count(F.col("rest"), p) for p in (r"\p{Lu}", r"\p{N}", _SPACE, _MARK, _SYMBOL)]
    rows = rows.select("*", F.length("text").cast("long").alias("n_chars"), F.length("rest").cast("long").alias("n_rest"), *[c.alias(f"c{k}") for k, c in enumerate(counted)])
    seen = [F.col(f"c{k}") for k in range(5)]
    classes = F.array(F.col("n_chars") - F.col("n_rest"), *seen, F.col("n_rest") - sum(seen[1:], seen[0]))
    return rows.select("row", "text", "words", "language", "n_chars", F.col("c2").alias("n_space"), F.col("c4").alias("n_symbols"), classes.alias("classes"), _common().alias("common"))


def _among(words: str, chosen: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*chosen)))


def _coded(words: str, letters: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.try_element_at(letters, w)), "")


def _common() -> Column:
    """Counts of the language's common words in order, then of all other words: each common word becomes a letter."""
    chosen = None
    for lang, words in COMMON.items():
        letter = F.create_map(*[F.lit(x) for k, w in enumerate(words) for x in (w, _CODES[k])])
        coded = _coded("frequent", letter)
        chosen = F.when(F.col("language") == lang, coded) if chosen is None else chosen.when(F.col("language") == lang, coded)
    letters = [F.lit(_CODES[k]) for k in range(max(map(len, COMMON.values())))]
    each = F.transform(F.array(chosen.otherwise("")), lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, c))).cast("long") for c in letters]))[0]
    return F.concat(each, F.array(F.size("words").cast("long") - F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each language its class and word histogram: medians, over all its documents of at least ``LEAST_WORDS`` words.

    Shares are rounded to thousandths and counted, so the medians are exact on that grid and don't depend on how rows lie. A
    language without such documents has no reference, and one without common words here has an empty word histogram.
    """
    rows = _histograms(docs).filter((F.size("words") >= LEAST_WORDS) & (F.col("n_chars") >= LEAST_CHARS))
    bins = F.concat(_shares(F.col("classes")), _shares(F.col("common")))
    # the positions of one document stay one row until the shares are counted: few distinct values a position
    exploded = rows.select("language", F.posexplode(F.transform(bins, lambda x: F.round(x * 1000).cast("int"))).alias("bin", "share"))
    exploded = exploded.filter((F.col("bin") < len(CLASSES)) | F.col("language").isin(*COMMON))
    counts = exploded.groupBy("language", "bin", "share").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.groupBy("language", "bin").agg(F.array_sort(F.collect_list(F.struct("share", "n"))).alias("grid"))  # at most 1001 shares
    half = F.aggregate("grid", F.lit(0).cast("long"), lambda a, g: a + g["n"]) / 2
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("at"))
    median = F.aggregate(
        "grid", start, lambda s, g: F.struct((s["n"] + g["n"]).alias("n"), F.when((s["at"] < 0) & (s["n"] + g["n"] >= half), g["share"]).otherwise(s["at"]).alias("at"))
    )["at"]
    found: dict[str, dict[int, int]] = {}
    for r in grid.select("language", "bin", median.alias("m")).collect():  # one number for each language and bin
        found.setdefault(r.language, {})[r.bin] = r.m
    made = {}
    for lang, values in found.items():
        flat = [values[k] for k in sorted(values)]
        parts = flat[: len(CLASSES)], flat[len(CLASSES) :]
        made[lang] = tuple([v / (sum(p) or 1) for v in p] for p in parts)
    return made


def _fixed(q: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of shares from a reference."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _repeated(words: Column) -> Column:
    """Words that lie in three-word windows which occur twice or more.

    A window is its hash with its place in the low bits, so one sort of plain numbers puts equal windows side by side. Windows whose
    hashes meet are compared by their words, so what hash bits are left doesn't matter.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("long")))

    def windows(b: Column) -> Column:
        first = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
        packed = F.transform(first, lambda w, i: F.call_function("shiftleft", F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), b).bitwiseOR(i.cast("long")))
        return F.sort_array(packed)

    def places(b: Column, s: Column) -> Column:
        def top(x: Column) -> Column:
            return F.call_function("shiftright", x, b)

        again = F.filter(s, lambda x, j: (top(x) == top(F.get(s, j - 1))) | (top(x) == top(F.get(s, j + 1))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
        return F.transform(again, lambda x: x.bitwiseAND(mask).cast("int"))

    def equal(found: Column) -> Column:
        # no word holds a space, so joined words are equal only if the words are
        named = F.sort_array(F.transform(found, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, F.lit(3))).alias("w"), i.alias("i"))))
        again = F.transform(F.array(named), lambda s: F.filter(s, lambda x, j: F.coalesce(x["w"] == F.get(s, j - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, j + 1)["w"], F.lit(False))))[0]
        return F.sort_array(F.transform(again, lambda x: x["i"].cast("long")))

    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    sorted_ = F.transform(F.array(bits), lambda b: F.struct(b.alias("b"), windows(b).alias("s")))
    placed = equal(F.transform(sorted_, lambda x: places(x["b"], x["s"]))[0])
    return F.aggregate(placed, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n")))["n"]


def judged(docs: DataFrame, known: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """``row`` (the columns of docs) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance (null where the text is too short or the language has no reference) and kept.

    A null text has no words. Reads ``text`` and ``lang``; a lang that is null or no code is the language whose common words occur
    most. A language without common words here is compared by its characters alone, with documents of the same language. Every row is judged by itself, so repeated rows get equal verdicts.
    """
    rows = _histograms(docs)
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    n = F.size("words").cast("long")
    none = F.lit(None).cast("double")
    by_class, by_word = none, none
    if known:
        langs = sorted(known)
        classes = F.map_from_arrays(F.array(*map(F.lit, langs)), F.array(*[_fixed(known[x][0]) for x in langs]))
        by_class = F.when(F.col("n_chars") >= LEAST_CHARS, _distance(_shares(F.col("classes")), F.try_element_at(classes, F.col("language"))))
    for lang in sorted(known.keys() & COMMON.keys()):
        here = (F.col("language") == lang) & (F.size("words") >= LEAST_WORDS)
        by_word = F.when(here, _distance(_shares(F.col("common")), _fixed(known[lang][1]))).otherwise(by_word)
    rows = rows.select(
        "row",
        n.alias("n_words"),
        (F.col("n_chars") - F.col("n_space")).alias("word_chars"),
        "n_symbols",
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        by_class.alias("class_distance"),
        by_word.alias("word_distance"),
    )
    failed = (F.col("n_words") < LEAST_BASE_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


def quality(docs: DataFrame) -> DataFrame:
    """References from all of ``docs``, then every row judged; see :func:`judged`. A table without rows gives none."""
    return judged(docs, references(docs))


def good_documents(docs: DataFrame) -> DataFrame:
    """The kept rows, all columns as they were.

    The row's place takes part in the filter so that the optimizer leaves it above the projections: pushed below them it would hold
    every measure written out, and compute words anew for each of their uses.
    """
    placed = quality(docs).withColumn("place", F.monotonically_increasing_id())
    return placed.filter((F.col("place") >= 0) & F.col("kept")).select("row.*")
