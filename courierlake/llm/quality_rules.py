"""Quality rules by distribution divergence [native].

Each whole text gives two histograms: character classes, and the commonest
words of a language against all other words. Both are compared with references
of its language (the one of four whose common words it has most of) by
Jensen-Shannon distance (base 2, so 0 to 1); a text is kept if it lies near
both references. The shorter a text, the farther its histograms stray by chance,
so the distance allowed falls with the square root of its length towards a
floor; below a minimum length a text says nothing and the comparison is passed.

Only DataFrame functions on array columns of one row; no shuffle, so no key,
source or group of copies can gather in a task. A repeat search inside one
text is a sort of its own window hashes (n log n).

Defined results: a null or empty text has no words and fails the base rules;
rows that repeat give repeated results; a null doc_id is kept as it is; very
long texts are read whole; an empty table gives no rows; other columns of the
table are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_text

# Shares of lower-case (or caseless) letters, capitals, digits, white space,
# sentence punctuation and anything else in running prose, by language.
CHAR_CLASSES = {
    "en": (0.786, 0.022, 0.004, 0.165, 0.022, 0.001),
    "de": (0.800, 0.035, 0.004, 0.135, 0.025, 0.001),
    "fr": (0.786, 0.020, 0.004, 0.160, 0.029, 0.001),
    "es": (0.790, 0.020, 0.004, 0.160, 0.025, 0.001),
}
# Shares of the commonest words among all words of running prose, by language.
COMMON_WORDS = {
    "en": {"the": 0.060, "of": 0.032, "and": 0.028, "to": 0.026, "in": 0.021, "a": 0.021, "that": 0.011, "is": 0.010, "was": 0.009, "it": 0.009, "for": 0.009, "on": 0.007},
    "de": {"der": 0.034, "die": 0.034, "und": 0.030, "in": 0.020, "den": 0.012, "von": 0.011, "zu": 0.011, "das": 0.010, "mit": 0.009, "ist": 0.009, "des": 0.008, "nicht": 0.008},
    "fr": {"de": 0.050, "la": 0.030, "le": 0.025, "et": 0.022, "les": 0.020, "des": 0.018, "en": 0.014, "un": 0.012, "du": 0.012, "une": 0.010, "est": 0.010, "que": 0.010},
    "es": {"de": 0.060, "la": 0.038, "que": 0.030, "el": 0.028, "en": 0.026, "y": 0.026, "los": 0.016, "a": 0.016, "se": 0.013, "del": 0.012, "las": 0.011, "un": 0.010},
}
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_CHARS, MIN_WORDS = 100, 20
# Distance allowed: a floor, and what is added for a text of one character or word.
CHAR_DISTANCE, WORD_DISTANCE = (0.15, 1.0), (0.24, 0.7)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares: H((p + q) / 2) - (H(p) + H(q)) / 2."""

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x) + part(y)) / 2 - part((x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # a one-element array binds the sorted pairs to a name, so that they are sorted once
    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    twice = F.transform(F.array(pairs), lambda s: F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)))
    starts = F.array_sort(F.transform(F.element_at(twice, 1), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(starts, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])


def joined(step: int) -> Column:
    """Each hash combined with the one `step` places on."""
    return F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + step)))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def measures(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, the column to carry along if any, the base counts and both distances (null: too short), one row per input row."""
    own = (carry,) if carry else ()
    words = id_text(docs, carry=carry).select("doc_id", *own, "text", words_of(F.col("text")).alias("words"))
    listed = sorted({w for share in COMMON_WORDS.values() for w in share})
    n = F.size("words")
    common = F.filter("words", lambda w: w.isin([*listed, *map(str.capitalize, listed)]))
    counts = words.select(
        "doc_id",
        *own,
        n.alias("n_words"),
        F.length("text").alias("n_chars"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_replace("text", r"[a-z\x20\x09-\x0Dà-öø-ÿß]+", "").alias("rare"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.concat(F.lit(" "), F.lower(F.array_join(common, "  ")), F.lit(" ")).alias("common"),
    )
    for step in (1, 2, 4):  # hashes of two words, then of four and eight; what runs past the end is cut off below
        rest = [c for c in counts.columns if c != "hashes"]
        counts = counts.select(*rest, joined(step).alias("hashes"))
    rest = [c for c in counts.columns if c != "hashes"]
    counts = counts.select(*rest, F.slice("hashes", 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))).alias("windows"))
    told = counts.select(
        "doc_id",
        *own,
        "n_words",
        "n_chars",
        "word_chars",
        count_of(F.col("rare"), r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), repeated(F.col("windows"))).otherwise(F.lit(0)).alias("n_repeat_words"),
        count_of(F.col("rare"), r"\p{Lu}").alias("capitals"),
        count_of(F.col("rare"), r"\p{Nd}").alias("digits"),
        count_of(F.col("rare"), r"[.,;:!?'\"()\-]").alias("points"),
        count_of(F.col("rare"), r"[^\p{L}\p{Nd}\x20\x09-\x0D.,;:!?'\"()\-]").alias("others"),
        *(((F.octet_length("common") - F.octet_length(F.replace(F.col("common"), F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).alias(f"w_{i}") for i, w in enumerate(listed)),
    )
    classes = {
        "lower": F.col("word_chars") - F.col("capitals") - F.col("digits") - F.col("points") - F.col("others"),
        "capitals": F.col("capitals"),
        "digits": F.col("digits"),
        "blank": F.col("n_chars") - F.col("word_chars"),
        "points": F.col("points"),
        "others": F.col("others"),
    }
    base = ("doc_id", *own, "n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    per_char, per_word = F.greatest(F.col("n_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    told = told.select(
        *base,
        F.array(*(c / per_char for c in classes.values())).alias("by_class"),
        *(F.array(*(F.col(f"w_{listed.index(w)}") / per_word for w in share)).alias(f"by_word_{lang}") for lang, share in COMMON_WORDS.items()),
    )
    # the language is the one whose common words the text has most of; without any, the first
    told = told.select(*told.columns, *(F.aggregate(f"by_word_{lang}", F.lit(0.0), lambda s, x: s + x).alias(f"seen_{lang}") for lang in COMMON_WORDS))
    most = F.greatest(*(F.col(f"seen_{lang}") for lang in COMMON_WORDS))

    def of_language(values: dict[str, Column]) -> Column:
        first, *others = values
        chosen = F.when(F.col(f"seen_{first}") == most, values[first])
        for lang in others:
            chosen = chosen.when(F.col(f"seen_{lang}") == most, values[lang])
        return chosen

    def fixed(values: tuple[float, ...]) -> Column:
        return F.array(*map(F.lit, values))

    told = told.select(
        *base,
        "by_class",
        of_language({lang: fixed(q) for lang, q in CHAR_CLASSES.items()}).alias("class_reference"),
        of_language({lang: F.concat(f"by_word_{lang}", F.array(F.greatest(1 - F.col(f"seen_{lang}"), F.lit(0.0)))) for lang in COMMON_WORDS}).alias("by_word"),
        of_language({lang: fixed((*share.values(), 1 - sum(share.values()))) for lang, share in COMMON_WORDS.items()}).alias("word_reference"),
    )
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return told.select(
        "doc_id",
        *own,
        *longs,
        F.col("n_chars").cast("long").alias("n_chars"),
        F.when(F.col("n_chars") >= MIN_CHARS, js_distance(F.col("by_class"), F.col("class_reference"))).alias("char_distance"),
        F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("by_word"), F.col("word_reference"))).alias("word_distance"),
    )


def allowed(distance: tuple[float, float], n: Column) -> Column:
    """The distance allowed for a text of n characters or words."""
    return F.lit(distance[0]) + F.lit(distance[1]) / F.sqrt(F.greatest(n, F.lit(1)))


def quality_rules(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, base counts, n_chars, base_failed, kept and the two distances (null: too short to compare), with the column to carry along if any."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fits = F.coalesce(F.col("char_distance") <= allowed(CHAR_DISTANCE, F.col("n_chars")), F.lit(True)) & F.coalesce(F.col("word_distance") <= allowed(WORD_DISTANCE, F.col("n_words")), F.lit(True))
    found = measures(docs, carry)
    # a filter on what follows stays above the generator: pushed below, it would repeat every measure for each of its uses
    found = found.select(F.explode(F.array(F.struct(*found.columns))).alias("found")).select("found.*")
    return found.select(*found.columns, failed.alias("base_failed"), (~failed & fits).alias("kept"))
