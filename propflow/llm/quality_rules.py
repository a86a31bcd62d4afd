"""Line-first cleaning in column expressions: rules per line, then a limit on what a text may lose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# A finished line ends in one of these marks; blanks, quotes and brackets may follow.
MARKS = ".!?:;…。！？؟।"
CLOSING = BLANKS + "\"'”’»)]"
# Marks in a row, as in shouting or filler.
RUNS = r"[!?]{2,}|[,;]{2,}|[.]{4,}|[-_=~]{4,}"
SEPARATORS = r"[|»›·•→]|&gt;| > | :: "
NAVIGATION = (
    r"\A[^a-z]*(home|menu|log ?in|log ?out|sign ?in|sign ?up|register|search|share|next|previous|back to top|"
    r"read more|see more|show more|skip to content|site ?map|contact us|about us|faq|my account|cart)[^a-z]*\z"
)
BOILERPLATE = (
    "all rights reserved", "copyright", "©", "licensed under", "license:", "cookie", "privacy policy",
    "terms of use", "terms of service", "javascript", "lorem ipsum", "newsletter", "click here",
    "powered by", "{", "}",
)
# What a line must hold before symbols, runs or separators can fail it: one look instead of three.
_SUSPECT = r"[#*$%&|<>›»·•→]|::|[!?]{2}|[,;]{2}|[.]{4}|[-_=~]{4}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once per row, also where inner functions use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def solid_chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.translate(text, BLANKS, ""))


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that a text has twice or more, first ones included.

    Windows are sorted by 64-bit hash and place, equal neighbours are marked, and the marked starts,
    in order, each add the words that the start before does not cover.
    """

    def windows(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        gram = lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p"))
        return F.sort_array(F.transform(heads, gram))

    def starts(s: Column) -> Column:
        equal = lambda x, i: F.coalesce(x["g"] == F.get(s, i - 1)["g"], F.lit(False)) | F.coalesce(
            x["g"] == F.get(s, i + 1)["g"], F.lit(False)
        )
        return F.sort_array(F.transform(F.filter(s, equal), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        add = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(p, first, add)["n"]

    return let(words, lambda w: let(windows(w), lambda s: covered(starts(s))))


def line_fails(line: Column, chars: Column) -> Column:
    """True for a line that a punctuation, navigation or boilerplate rule removes; blank lines pass.

    `chars` are the line's code points outside white space.
    """
    runs = F.regexp_count(line, F.lit(RUNS))
    finished = F.substring(F.rtrim(line, F.lit(CLOSING)), -1, 1).isin(*MARKS)
    marks = (
        (symbol_count(line) * 10 >= chars)
        | (F.regexp_count(line, F.lit(SEPARATORS)) >= 3)
        | ((runs > 0) & (runs * 4 >= F.regexp_count(line, F.lit(WORD))))
    )
    low = F.lower(line)
    phrase = low.contains(BOILERPLATE[0])
    for words in BOILERPLATE[1:]:
        phrase = phrase | low.contains(words)
    return (chars > 0) & (~finished | (line.rlike(_SUSPECT) & marks) | phrase | low.rlike(NAVIGATION))


def _line_verdicts(text: Column) -> Column:
    sized = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), solid_chars(x).alias("chars")))
    return F.transform(
        sized, lambda x: F.struct(x["line"], x["chars"], line_fails(x["line"], x["chars"]).alias("fails"))
    )


def clean_text(text: Column) -> Column:
    """The text without the lines that fail; null stays null."""
    kept = F.filter(_line_verdicts(text), lambda x: ~x["fails"])
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def quality_report(
    docs: DataFrame, *carried: str, most_lost: float = 0.3, fewest_words: int = 50, most_repeated: int = 50
) -> DataFrame:
    """Carried columns, counts, line verdicts and `kept` for every row; one scan, no shuffle.

    `kept` needs the base rules (enough words, not too many in repeated windows) and a cleaning
    that loses at most `most_lost` of the characters outside white space. A null text counts as
    empty: no words, so it fails. Rows never influence each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    total = lambda marks, test: F.aggregate(
        marks, F.lit(0), lambda acc, x: acc + F.when(test(x), x["chars"]).otherwise(0)
    )
    repeats = lambda solid: F.size(solid) - F.size(F.array_distinct(solid))
    lines = let(
        _line_verdicts(text),
        lambda marks: F.struct(
            F.size(F.filter(marks, lambda x: x["fails"])).alias("removed"),
            total(marks, lambda x: x["fails"]).alias("lost"),
            repeats(F.transform(F.filter(marks, lambda x: x["chars"] > 0), lambda x: x["line"])).alias("dup"),
        ),
    )
    counted = docs.select(
        *carried,
        let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeated"))).alias("_words"),
        solid_chars(text).alias("_chars"),
        symbol_count(text).alias("_symbols"),
        lines.alias("_lines"),
    )
    n, repeated = F.col("_words")["n"].cast("long"), F.col("_words")["repeated"].cast("long")
    failed = (n < fewest_words) | (100 * repeated > most_repeated * n)
    lost = F.col("_lines")["lost"].cast("long")
    kept = ~failed & (lost <= F.lit(float(most_lost)) * F.col("_chars"))
    return counted.select(
        *carried,
        n.alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_lines")["dup"].cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        kept.alias("kept"),
        F.col("_lines")["removed"].cast("long").alias("n_lines_removed"),
        lost.alias("chars_removed"),
    )


def clean_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows that are kept, their text cleaned; other columns as they are."""
    report = quality_report(docs.select(F.struct("*").alias("_row"), "text"), "_row", **limits)
    kept = report.where("kept").select("_row.*")
    return kept.withColumn("text", clean_text(F.col("text"))).select(*docs.columns)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def quality_sql(most_lost: float = 0.3, fewest_words: int = 50, most_repeated: int = 50) -> str:
    """The same report in DuckDB's SQL, over `documents`."""
    closing = " || ".join(f"chr({ord(c)})" for c in CLOSING)
    phrases = " OR ".join(f"contains(low, '{words}')" for words in BOILERPLATE)
    blanks, symbols = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) > 2),
t AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM g),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
s AS (SELECT DISTINCT doc_id, p + k AS p FROM r, (SELECT unnest([0, 1, 2]) AS k)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, line, lower(line) AS low, length(regexp_replace(line, '{blanks}', '', 'g')) AS chars FROM l),
v AS (SELECT doc_id, line, chars, chars > 0 AND (
    NOT coalesce(contains('{MARKS}', nullif(right(rtrim(line, {closing}), 1), '')), false)
    OR (length(line) - length(regexp_replace(line, '{symbols}', '', 'g'))) * 10 >= chars
    OR len(regexp_extract_all(line, {_quoted(RUNS)})) * 4 >= len(regexp_extract_all(line, '{WORD}'))
    OR len(regexp_extract_all(line, {_quoted(SEPARATORS)})) >= 3
    OR regexp_matches(low, {_quoted(NAVIGATION)}) OR {phrases}) AS fails FROM m),
x AS (SELECT doc_id, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS dup,
    count(*) FILTER (fails) AS removed, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost FROM v GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{blanks}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '{symbols}', '', 'g')))::BIGINT AS n_symbols, dup AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, removed AS n_lines_removed, lost AS chars_removed
    FROM w JOIN x USING (doc_id) LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < {fewest_words} OR 100 * n_repeat_words > {most_repeated} * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND chars_removed <= {most_lost}::DOUBLE * word_chars AS kept FROM b
"""
