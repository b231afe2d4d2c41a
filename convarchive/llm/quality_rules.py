"""Quality rules, line first: lines that fail a rule go, then documents that lose too much text.

Everything is DataFrame expressions over one row; nothing is shuffled. A line is judged on five rules:

* punctuation: it has fewer than 10 words and doesn't end as a sentence does, with one of ``. ! ? … : ;`` and
  perhaps closing quotes or brackets;
* shouting or symbols: over a tenth of its characters are ``!#*$%&|<>``, or it has 20 letters or more, over
  60 % of them capitals;
* navigation: three or more items divided by ``|``, ``»``, ``>`` or a bullet with spaces around them;
* boilerplate: a phrase of consent banners, menus and legal footers, in a line of under 40 words;
* monotony: 10 words or more, with fewer distinct words than a fifth of them.

A line without a word counts for nothing. A document is kept if its kept lines hold at least half of its
characters. Null and empty texts have no words, fail the base rules and are not kept; very long texts are
read whole; repeated rows are each judged; further columns are left alone, and one called like an output is
kept under its name and ``_input``.

Rules are tried by cost: what a cheap search rules out isn't counted, and a line is cut into words once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import let, put_back, require, set_aside, table, words

SYMBOLS = r"[#*$%&|<>]"
ENDING = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*\z"
#: Phrases of boilerplate, in lower case.
BOILERPLATE = [
    "accept all cookies", "all rights reserved", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "sign up for our newsletter", "skip to content", "terms of service", "terms of use",
    "we use cookies", "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados",
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_KEPT_SHARE = 0.5
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "kept_share", "base_failed", "kept")
INNER = ("__base", "__lines")


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def repeated_words(tokens: Column) -> Column:
    """How many words stand in a window of three words that the text has twice or more."""

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        again = let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["g"] == x["g"])),
            ),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            starts,
            zero,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))
        return F.when(F.size(w) < 4, 0).otherwise(counted)

    return let(tokens, of)


def any_of(phrases: list[str]) -> str:
    """A pattern of some phrases, by first letter, so that a place is tried against few of them."""
    by: dict[str, list[str]] = {}
    for p in phrases:
        by.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items())


def line_fails(line: Column) -> Column:
    # over half of the letters are capitals only where two of them follow each other
    letters = without(line, r"[^\p{L}]")
    shouts = (F.length(letters) >= 20) & (F.lit(10) * F.length(without(letters, r"\p{Lu}")) < F.lit(4) * F.length(letters))
    by_words = lambda w: (
        ((F.size(w) < 10) & ~line.rlike(ENDING))
        | ((F.size(w) < 40) & F.lower(line).rlike(any_of(BOILERPLATE)))
        | ((F.size(w) >= 10) & (F.lit(5) * F.size(F.array_distinct(w)) < F.size(w)))
    )
    return (
        (F.lit(10) * F.regexp_count(line, F.lit(r"[!#*$%&|<>]")) > F.length(line))
        | (line.rlike(r"\p{Lu}[^\p{L}]*+\p{Lu}") & shouts)
        | (F.regexp_count(line, F.lit(r" [|»>•·] ")) >= 3)
        | let(words(line), by_words)
    )


def quality_rules(documents: DataFrame) -> DataFrame:
    """``documents`` with base counts, ``clean_text`` (lines that pass), ``kept_share``, ``base_failed`` and ``kept``."""
    given = documents
    documents = set_aside(require(documents, "text"), *OUTPUTS, *INNER)
    text = F.coalesce(F.col("text"), F.lit(""))
    w = words(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = let(w, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("rep")))
    cleaned = let(
        lines,
        lambda x: F.struct(
            (F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            F.length(F.array_join(x, "")).alias("all"),
            F.filter(x, lambda y: ~line_fails(y)).alias("good"),
        ),
    )
    n, share = F.col("__base.n"), F.col("__lines.all")
    out = (
        documents.withColumns({"__base": base, "__lines": cleaned})
        .withColumns(
            {
                "n_words": n.cast("long"),
                "word_chars": F.col("__base.chars").cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": F.col("__lines.dup").cast("long"),
                "n_repeat_words": F.col("__base.rep").cast("long"),
                "clean_text": F.array_join("__lines.good", "\n"),
                "kept_share": F.when(share > 0, F.length(F.array_join("__lines.good", "")) / share).otherwise(0.0),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT_SHARE))
        .drop(*INNER)
    )
    return put_back(out, given, (*OUTPUTS, *INNER), INNER)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
g2 AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM g),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g2) WHERE c > 1),
cov AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
line AS (SELECT r, unnest(l) AS x FROM l),
judged AS (SELECT r, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, regexp_replace(x, '[^\p{L}]', '', 'g') AS letters FROM line),
ok AS (SELECT r, x, NOT (
    10 * (length(x) - length(regexp_replace(x, '[!#*$%&|<>]', '', 'g'))) > length(x)
    OR (length(letters) >= 20 AND 10 * length(regexp_replace(letters, '\p{Lu}', '', 'g')) < 4 * length(letters))
    OR len(regexp_extract_all(x, ' [|»>•·] ')) >= 3
    OR (regexp_matches(lower(x), '""" + "|".join(BOILERPLATE) + r"""') AND len(w) < 40)
    OR (len(w) < 10 AND NOT regexp_matches(x, '[.!?…:;]["''”’»)\]]*[\x20\x09-\x0D]*\z'))
    OR (len(w) >= 10 AND 5 * len(list_distinct(w)) < len(w))) AS good FROM judged),
share AS (SELECT r, coalesce(sum(length(x)) FILTER (WHERE good), 0) / sum(length(x)) AS share FROM ok GROUP BY r),
b AS (SELECT d.r, doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(share, 0) AS share
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN cov USING (r) LEFT JOIN share USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND share >= 0.5 AS kept
FROM b
"""
