"""Keyword search for lists of any length: texts and keywords meet in joins, no expression depends on the list.

A keyword of word characters lies inside one word of a text (in `word` mode it is the word), so it is
joined with the distinct words: with the words themselves or, in `literal` mode, with all their parts of
a keyword's length. Words and keywords grow more slowly than texts, and no pair is looked at in vain.

Other keywords, and those longer than `WORD_LIMIT`, are entered under one of their character grams,
the one that fewest texts hold. A text can only hold a keyword whose gram it holds; what the join on
grams finds is verified. Texts are told apart by content: equal ones are looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propflow.session import materialize

GRAM = 4
WORD = r"(?U)\w+"
WORD_LIMIT = 64


def _grams(text: Column, size: int) -> Column:
    """All runs of `size` characters, each once; one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _entries(keywords: DataFrame, gram: int) -> DataFrame:
    """(keyword, size, gram): all grams of each lower-cased keyword, of its own length where it is shorter."""
    words = keywords.select(F.lower(keywords.columns[0]).alias("keyword")).where("keyword <> ''").distinct()
    size = F.least(F.length("keyword"), F.lit(gram))
    sizes = [F.when(size == k, _grams(F.col("keyword"), k)) for k in range(1, gram + 1)]
    return words.select("keyword", size.alias("size"), F.explode(F.coalesce(*sizes)).alias("gram"))


def keyword_index(grams: DataFrame, keywords: DataFrame, gram: int = GRAM) -> DataFrame:
    """(keyword, gram): each keyword under its gram that occurs in fewest of `grams` (key, gram)."""
    entries = _entries(keywords, gram)
    held = grams.join(entries.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = entries.join(held, "gram", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))
    best = counted.groupBy("keyword").agg(rarest.alias("best"))
    return best.where("best.n > 0").select("keyword", "best.gram")  # a gram no text holds finds nothing


def _distinct_texts(texts: DataFrame, column: str) -> DataFrame:
    """(text, text_key, key) of the distinct lower-cased texts, written down."""
    low = texts.select(F.lower(column).alias("text")).where("text is not null")
    distinct = low.withColumn("text_key", _text_key(F.col("text"))).dropDuplicates(["text_key"])
    return materialize(distinct.withColumn("key", F.monotonically_increasing_id()))  # 8 bytes go beside a gram


def _sizes(entries: DataFrame) -> list[int]:
    return sorted(r["size"] for r in entries.select("size").distinct().collect())


def _gram_hits(distinct: DataFrame, keywords: DataFrame, mode: str, gram: int) -> DataFrame | None:
    """(key, keyword) by grams; None where there is no keyword."""
    sizes = _sizes(_entries(keywords, gram))  # at most `gram` numbers
    if not sizes:
        return None
    all_grams = F.flatten(F.array(*(_grams(F.col("text"), k) for k in sizes)))
    grams = distinct.select("key", F.explode(all_grams).alias("gram"))
    # only grams that some keyword has go on: they are written once and read for the counts and the join
    wanted = _entries(keywords, gram).select("gram").distinct()
    grams = materialize(grams.join(wanted, "gram", "left_semi"))
    index = materialize(keyword_index(grams, keywords, gram))
    pairs = grams.join(index, "gram").select("key", "keyword")
    looked = pairs.join(distinct, "key")
    hit = F.contains("text", "keyword")
    if mode == "word":
        quoted = F.concat(F.lit("\\Q"), F.replace("keyword", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        hit = hit & F.rlike("text", F.concat(F.lit("(?U)\\b"), quoted, F.lit("\\b")))
    return looked.where(hit).select("key", "keyword")


def _words(distinct: DataFrame) -> DataFrame:
    """(key, word): the different words of each text."""
    return distinct.select("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))


def _keywords_of_words(words: DataFrame, keywords: DataFrame) -> DataFrame:
    """(word, id, keyword): the keywords (id, keyword) that each of the distinct words holds."""
    sizes = _sizes(keywords.select(F.length("keyword").alias("size")))  # at most WORD_LIMIT numbers
    if not sizes:
        return words.select("word", F.lit(0).cast("bigint").alias("id"), F.lit("").alias("keyword")).where("false")
    fitting = F.array(*map(F.lit, sizes))
    sized = words.select("word", F.explode(F.filter(fitting, lambda k: k <= F.length("word"))).alias("size"))
    cut = F.coalesce(*(F.when(F.col("size") == k, _grams(F.col("word"), k)) for k in sizes))
    return sized.select("word", F.explode(cut).alias("keyword")).join(keywords, "keyword").select("word", "id", "keyword")


class _Found:
    """What both ways find: `distinct` texts, hits by words and by grams.

    Of `by_words`, (key, word) goes with (word, id, keyword); `by_grams` is (key, keyword) or None. No
    keyword is in both.
    """

    def __init__(self, texts: DataFrame, column: str, keywords: DataFrame, mode: str, gram: int):
        if mode not in ("literal", "word"):
            raise ValueError(f"mode {mode!r}: only literal and word keywords can be indexed")
        self.distinct = _distinct_texts(texts, column)
        low = keywords.select(F.lower(keywords.columns[0]).alias("keyword")).where("keyword <> ''").distinct()
        low = materialize(low.withColumn("id", F.monotonically_increasing_id()))
        plain = F.col("keyword").rlike(r"(?U)\A\w+\z") & (F.length("keyword") <= WORD_LIMIT)
        own = low.where(plain)
        self.words = _words(self.distinct)
        if mode == "word":
            self.held = own.withColumn("word", F.col("keyword"))
        else:
            self.words = materialize(self.words)
            self.held = materialize(_keywords_of_words(self.words.select("word").distinct(), own))
        self.by_grams = _gram_hits(self.distinct, low.where(~plain).select("keyword"), mode, gram)


def keyword_hits(texts: DataFrame, column: str, keywords: DataFrame, mode: str = "literal", gram: int = GRAM) -> DataFrame:
    """(text_key, keyword): the lower-cased keywords that each distinct lower-cased text holds.

    keywords is a table whose first column holds them. `literal` is containment; `word` asks that no
    letter, digit or underscore of any script follows or precedes on either side what is one itself
    at the keyword's ends. Null texts and null or empty keywords hit nothing.
    """
    found = _Found(texts, column, keywords, mode, gram)
    hits = found.words.join(found.held, "word").select("key", "keyword").distinct()
    hits = hits if found.by_grams is None else hits.unionByName(found.by_grams)
    return hits.join(found.distinct.select("key", "text_key"), "key").select("text_key", "keyword")


def rows_with_keywords(rows: DataFrame, columns: list[str], keywords: DataFrame, mode: str = "literal", gram: int = GRAM) -> DataFrame:
    """The rows whose every one of `columns` holds a keyword."""
    for column in columns:
        found = _Found(rows, column, keywords, mode, gram)
        keys = found.words.join(found.held, "word", "left_semi").select("key")
        keys = (keys if found.by_grams is None else keys.unionByName(found.by_grams.select("key"))).distinct()
        hits = found.distinct.join(keys, "key", "left_semi").select(F.col("text_key").alias("_hit"))
        rows = rows.join(hits, _text_key(F.lower(column)) == F.col("_hit"), "left_semi")
    return rows


def with_keywords(rows: DataFrame, column: str, keywords: DataFrame, mode: str = "literal", gram: int = GRAM) -> DataFrame:
    """Adds `n_keywords`, how many different keywords the column holds, and `first_keyword` in their order."""
    found = _Found(rows, column, keywords, mode, gram)
    # a word brings the ids of its keywords as one row, so a text's hits move as numbers
    held = found.held.groupBy("word").agg(F.collect_list("id").alias("ids"), F.min("keyword").alias("first"))
    by_words = found.words.join(held, "word").groupBy("key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).cast("bigint").alias("n"), F.min("first").alias("first")
    )
    if found.by_grams is not None:
        by_grams = found.by_grams.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("keyword").alias("first"))
        by_words = by_words.unionByName(by_grams).groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    hits = by_words.join(found.distinct.select("key", "text_key"), "key").select(
        "text_key", F.col("n").alias("n_keywords"), F.col("first").alias("first_keyword")
    )
    joined = rows.join(hits, _text_key(F.lower(column)) == F.col("text_key"), "left").drop("text_key")
    return joined.withColumn("n_keywords", F.coalesce("n_keywords", F.lit(0)))
