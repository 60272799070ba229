"""Line-first cleaning with DataFrame functions only.

Every line of a text is held against three rules, failing lines are removed,
and a document that loses too large a share of its words' characters is rejected.

Rules for a line that has a word (blank lines are never judged and always stay):

* punctuation: at least one mark of `[#*$%&<>{}=~^_\\]` or of doubled `!`/`?` per two words, or no letter and no digit,
* navigation: three or more separators `|`, `»`, `›`, `•`, `→`, or a bare list of two or more menu words,
* boilerplate: a phrase of BOILERPLATE.

A document is rejected when it fails the base limits, or when more than
`max_lost_pct` percent of its word characters were in removed lines.

Defined results: a null or empty text has no words, so it fails the base limits; repeated
rows are judged one by one and all come back; an empty table gives an empty table; columns
of the input other than the id and the text come back untouched by `clean` (one
named `quality` is replaced) and are never read. Everything happens within a row, so no row is shuffled and no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, words

SYMBOLS = r"[#*$%&|<>]"

# Fixed phrases that mark boilerplate lines.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "accept cookies", "enable javascript", "subscribe to our newsletter", "sign up for", "click here", "log in to",
    "follow us on", "share this", "skip to content", "back to top", "lorem ipsum", "licensed under the", "copyright (c)",
    "spdx-license-identifier",
)
# Fixed menu words; a line made of these alone is navigation.
MENU = (
    "home", "about", "contact", "login", "logout", "register", "search", "menu", "next", "previous", "sitemap", "help",
    "faq", "archive", "blog", "shop", "cart",
)

BOILERPLATE_PATTERN = "(?i)" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)
MENU_PATTERN = r"(?i)^\W*(?:" + "|".join(MENU) + r")(?:\W+(?:" + "|".join(MENU) + r"))+\W*$"
MARKS = r"[#*$%&<>{}=~^_\\]|[!?][!?]+"
SEPARATORS = "[|»›•→]"
HAS_WORD = r"[^\x20\x09-\x0D]"
NEITHER = r"^[^\p{L}\p{N}]*$"


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def failing(line: Column) -> Column:
    """Whether a line that has a word fails a rule."""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    return (
        (F.regexp_count(line, F.lit(MARKS)) * 2 >= n_words)
        | line.rlike(NEITHER)
        | (F.regexp_count(line, F.lit(SEPARATORS)) >= 3)
        | line.rlike(MENU_PATTERN)
        | line.rlike(BOILERPLATE_PATTERN)
    )


def _repeat_words(grams: Column) -> Column:
    """Words inside windows that occur twice, from the hashes of all windows in text order.

    After sorting (hash, place), equal windows are neighbours. The covered words are then
    counted from the distances of the repeated places.
    """
    ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(s: Column, x: Column, at: Column) -> Column:
        return F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))

    def covered(s: Column) -> Column:
        repeated = F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1))
        places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        none = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            places, none,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        )["n"]

    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(ranked, covered))


def clean(
    documents: DataFrame, text: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_lost_pct: int = 40,
) -> DataFrame:
    """All rows and columns of `documents`, with one struct column `quality` added.

    `quality` holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines and n_bad_lines (lines with a word; those removed), lost_chars, kept and clean_text
    (the text without the removed lines).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # One step per select: a value that is used more than once must not be inlined into its users.
    own = documents.select(F.struct("*").alias("row"), body.alias("t"))
    own = own.select(
        "row", words(F.col("t")).alias("w"), F.regexp_count("t", F.lit(SYMBOLS)).alias("n_symbols"),
        F.transform(F.split(F.col("t"), "\n"), lambda x: F.struct(
            x.alias("line"), x.rlike(HAS_WORD).alias("word"), (x.rlike(HAS_WORD) & failing(x)).alias("bad"),
        )).alias("judged"),
    )
    w = F.col("w")
    gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    own = own.select(
        "row", "n_symbols", "judged", F.size(w).alias("n_words"), F.length(F.concat_ws("", w)).alias("word_chars"),
        F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram))
        .otherwise(F.array().cast("array<bigint>")).alias("grams"),
        F.filter("judged", lambda x: x["word"])["line"].alias("lines"),
        F.filter("judged", lambda x: x["bad"])["line"].alias("bad"),
    )
    own = own.select(
        "row", "n_symbols", "n_words", "word_chars", F.size("lines").alias("n_lines"), F.size("bad").alias("n_bad_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("grams")).alias("n_repeat_words"),
        F.when(F.size("bad") > 0, _word_chars(F.concat_ws("", "bad"))).otherwise(0).alias("lost_chars"),
        F.concat_ws("\n", F.filter("judged", lambda x: ~x["bad"])["line"]).alias("clean_text"),
    )
    own = own.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct),
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_pct)
    own = own.withColumn("kept", kept)
    number = [
        F.col(c).cast("bigint").alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "lost_chars",
        )
    ]
    quality = F.struct(*number, "base_failed", "kept", "clean_text").alias("quality")
    return own.select(*[F.col("row")[c].alias(c) for c in documents.columns if c != "quality"], quality)
