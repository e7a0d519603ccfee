"""Text expressions built from Spark SQL functions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.functions.wordlists import COMMON_WORDS, EMOTICONS, SPECIAL_MARKS

# White space beyond what the regular expression class \\s holds.
RARE_SPACES = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What cleaning removes, in order, and the marks it keeps.
LINK = r"(?:http|www)\S+"
MAIL = r"(?<=^|\s)\S[^\s@]*+@\S+"
MENTION_OR_TAG = r"(?U)[@#]\w+"
KEPT_MARKS = ".,!?-:"
KEPT_SPACES = " \t\n\x0b\f\r"
# Other scripts as ranges: all beyond ASCII but А-Я and а-я. The same class negated takes ten times as long.
OTHER_LETTERS = r"[\x{80}-\x{40f}\x{450}-\x{10ffff}]+"

BLANKED_MARKS = "".join(
    chr(i) for i in range(128) if not chr(i).isalnum() and chr(i) not in KEPT_MARKS + KEPT_SPACES
)
DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
UPPER = r"\p{IsUppercase}"
TOKEN = r"(?U)\b\w\w+\b"
PROSE_WORD = r"\s+[a-zA-Zа-яА-Я]+\s+"


def bind(value: Column, body) -> Column:
    """Compute ``value`` once per row and hand it to ``body``.

    A lambda that names an outer expression computes it again for every element, and merged
    projections repeat it per use; a one-element array holds it fixed.
    """
    return F.get(F.transform(F.array(value), body), 0)


def plain_spaces(c: Column) -> Column:
    """Rare white space as blanks, so that the fast ASCII class finds all of it."""
    return F.translate(c, RARE_SPACES, " " * len(RARE_SPACES))


def clean_text(c: Column) -> Column:
    """Drop links, mails, mentions and tags, blank other marks, collapse spaces, lower the case.

    Mails are matched from the start of a run without backing up, so one long unbroken run costs
    linear time; a text without an @ has none to look for. ASCII marks are blanked by a table, only other scripts by a pattern.
    """
    out = plain_spaces(F.coalesce(c, F.lit("")))
    out = F.regexp_replace(out, LINK, "")
    out = bind(out, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, MAIL, "")).otherwise(t))
    out = F.regexp_replace(out, MENTION_OR_TAG, "")
    out = F.translate(out, BLANKED_MARKS, " " * len(BLANKED_MARKS))
    out = F.regexp_replace(out, OTHER_LETTERS, " ")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.lower(F.trim(out))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(plain_spaces(c), r"\s+"), lambda w: w != "")


def count_marks(c: Column, marks: str) -> Column:
    """How many characters are one of these ASCII marks."""
    return F.length(c) - F.length(F.translate(c, marks, ""))


def count_matching(c: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def count_literal(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.replace(c, F.lit(literal), F.lit(""))
    return ((F.length(c) - F.length(gone)) / len(literal)).cast("int")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def text_statistics(c: Column, parts: Column | None = None, count: Column | None = None) -> dict[str, Column]:
    """Ten statistics of a text column; an empty or null one has 0 everywhere.

    ``parts`` and ``count`` are its words and their number where they are at hand; each use would split the text again.
    """
    text = F.coalesce(c, F.lit(""))
    parts = words(text) if parts is None else parts
    count = F.size(parts) if count is None else count
    chars = F.length(text)
    letters = F.length(F.array_join(parts, ""))
    common = F.size(F.filter(parts, lambda w: F.lower(w).isin(*COMMON_WORDS)))
    emoticons = sum((count_literal(text, e) for e in EMOTICONS[1:]), count_literal(text, EMOTICONS[0]))
    return {
        "char_count": chars,
        "word_count": count,
        "sentence_count": F.when(chars > 0, F.greatest(F.lit(1), count_marks(text, ".!?"))).otherwise(0),
        "avg_word_length": _share(letters, count),
        "unique_words_ratio": _share(F.size(F.array_distinct(parts)), count),
        "stopword_ratio": _share(common, count),
        "digit_count": count_matching(text, DIGITS),
        "uppercase_ratio": _share(count_matching(text, UPPER), chars),
        "special_char_ratio": _share(count_marks(text, SPECIAL_MARKS), chars),
        "emoticon_count": emoticons,
    }


def tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _zipped(columns: list[Column], names: list[str], length: Column) -> Column:
    """The first ``length`` rows of string arrays zipped into structs."""
    fields = ",".join(f"{n}:string" for n in names)
    return F.slice(F.arrays_zip(*columns), 1, F.greatest(length, F.lit(0))).cast(f"array<struct<{fields}>>")


def _joined_windows(terms: Column, n: int) -> Column:
    """Each run of ``n`` neighbouring terms, joined by a space; null where one of them is."""
    names = [f"t{k}" for k in range(n)]
    shifted = [F.slice(terms, k + 1, F.greatest(F.size(terms) - k, F.lit(0))) for k in range(n)]
    rows = _zipped(shifted, names, F.size(terms) - n + 1)

    def joined(r: Column) -> Column:
        parts = [r[names[0]]]
        for name in names[1:]:
            parts += [F.lit(" "), r[name]]
        return F.concat(*parts)

    return F.transform(rows, joined)


def ngrams(terms: Column, sizes: tuple[int, int]) -> Column:
    """All n-grams of a token array, for n from ``sizes[0]`` to ``sizes[1]``.

    A null in the array stands for a token that no n-gram may hold.
    """
    span = range(sizes[0], sizes[1] + 1)
    whole = bind(terms, lambda t: F.concat(*[t if n == 1 else _joined_windows(t, n) for n in span]))
    return F.array_compact(whole)


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of one row: run lengths of the sorted terms."""

    def runs(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), ordered)
        pairs = _zipped([ordered, before], ["term", "before"], F.size(ordered))
        marked = F.transform(
            pairs, lambda p, i: F.struct(p["term"].alias("term"), p["before"].alias("before"), i.alias("at"))
        )
        return F.filter(marked, lambda p: ~p["term"].eqNullSafe(p["before"]))

    def lengths(ordered: Column) -> Column:
        return bind(
            runs(ordered),
            lambda starts: F.transform(
                starts,
                lambda p, i: F.struct(
                    p["term"].alias("term"),
                    (F.coalesce(F.get(starts, i + 1)["at"], F.size(ordered)) - p["at"]).alias("tf"),
                ),
            ),
        )

    return bind(F.sort_array(terms), lengths)
