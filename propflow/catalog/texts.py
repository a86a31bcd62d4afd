"""Page text, stored search responses, snippets and their prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from propflow.catalog.standin import table
from propflow.fixed_values import LICENSE_RULE, SNIPPET_PROMPT, SNIPPET_SHORT, SNIPPET_TOP, SNIPPET_WINDOW
from propflow.functions.text import html_to_text, route_of
from propflow.operators import retrieval
from propflow.sources.search import flatten_responses

# name and alias looked for in each language
NAMES = {"en": ("with", "(5"), "fr": ("dans", "que l"), "de": ("nicht", "ie de"), "es": ("para", "+1 (")}
TERMS = {
    "terms": ["and", "der", "les", "que"],
    "phrases": ["of the", "in der"],
    "strong_units": ["ppm", "555-"],
    "weak_units": ["ing ", "keit"],
    "durations": ["1 (", "tion."],
}


def page_text(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "html")
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


def route_by_suffix(spark, sf):
    """Pages routed by suffix, `.html` read as `.pdf` to have both routes."""
    pages = table(spark, sf, "pages", "page_id", "url")
    url = F.regexp_replace("url", r"\.html$", ".pdf")
    return pages.select("page_id", route_of(url).alias("route"))


def search_flatten(spark, sf):
    """Each page as a stored response of two hits, the first licensed when fetched by https."""
    pages = table(spark, sf, "pages", "page_id", "url", "html")
    rule = "struct<_type: string, license: struct<name: string, url: string>>"
    none = F.lit(None).cast(f"array<{rule}>")
    other = F.struct(F.lit("ContractualRules/TextAttribution").alias("_type"), F.lit(None).cast(
        "struct<name: string, url: string>").alias("license"))
    licensed = F.struct(
        F.lit(LICENSE_RULE).alias("_type"),
        F.struct(F.concat(F.lit("License "), "page_id").alias("name"), F.col("url").alias("url")).alias("license"),
    )
    rules = F.when(F.col("url").startswith("https"), F.array(other, licensed, licensed)).otherwise(none)

    def hit(name, snippet, rules):
        return F.struct(
            name.alias("name"), F.col("url").alias("url"), snippet.alias("snippet"), rules.alias("contractualRules")
        )

    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    hits = F.array(hit(title, F.col("html"), rules), hit(F.lit("second"), F.lit(None).cast("string"), none))
    body = F.to_json(F.struct(F.struct(hits.alias("value")).alias("webPages")))
    stored = pages.select(F.col("page_id").cast("string").alias("asked"), body.alias("response"))
    return flatten_responses(stored, "asked", "response")


def _named_documents(spark, sf):
    lang = F.col("lang")
    name, alias = (
        F.create_map(*(F.lit(x) for key, pair in NAMES.items() for x in (key, pair[i])))[lang] for i in (0, 1)
    )
    documents = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return documents.withColumns({"name": name, "alias": alias})


def _snippets(spark, sf):
    keep = ["doc_id", "lang", "source", "name", "alias"]
    return retrieval.explode_snippets(_named_documents(spark, sf), "text", "name", "alias", keep)


def snippet_windows(spark, sf):
    return _snippets(spark, sf).select("doc_id", "pos", "start", "snippet")


def _scored(spark, sf):
    return retrieval.score_snippets(_snippets(spark, sf), "name", "alias", **TERMS)


def snippet_score(spark, sf):
    return _scored(spark, sf).select("doc_id", "pos", "score")


def topk_snippets(spark, sf):
    top = retrieval.top_snippets(_scored(spark, sf), "source", ["doc_id", "pos"])
    return top.select("source", "place", "doc_id", "pos", "score", "snippet")


def snippet_prompt(spark, sf):
    top = retrieval.top_snippets(_scored(spark, sf), "lang", ["doc_id", "pos"])
    entities = _named_documents(spark, sf).select("lang", "name", "alias").distinct()
    prompts = retrieval.snippet_prompts(entities, top, "lang", "name", "alias")
    return retrieval.search_query(prompts, "name").select("lang", "query", "prompt")


QUERIES = {
    "html_to_text": page_text,
    "route_by_suffix": route_by_suffix,
    "search_flatten": search_flatten,
    "snippet_windows": snippet_windows,
    "snippet_score": snippet_score,
    "topk_snippets": topk_snippets,
    "snippet_prompt": snippet_prompt,
}


# Rules of their own, by what the pages hold: no quoted `>`, four named entities.
PAGE_TEXT_SQL = """
WITH pieces AS (
  SELECT page_id, html, unnest(string_split(regexp_replace(regexp_replace(html,
    '<script>[^<]*(<[^<]*)?</script>|<style>[^<]*</style>', '', 'g'), '<!--[^>]*-->', '', 'g'), '<')) AS piece,
    generate_subscripts(string_split(regexp_replace(regexp_replace(html,
    '<script>[^<]*(<[^<]*)?</script>|<style>[^<]*</style>', '', 'g'), '<!--[^>]*-->', '', 'g'), '<'), 1) AS i
  FROM pages),
bare AS (
  SELECT page_id, string_agg(CASE WHEN i = 1 THEN piece ELSE substring(piece, strpos(piece, '>') + 1) END, ''
    ORDER BY i) AS text
  FROM pieces GROUP BY page_id)
SELECT page_id, replace(replace(replace(replace(b.text, '&copy;', '\u00a9'), '&middot;', '\u00b7'), '&quot;', '"'),
  '&amp;', '&') AS text
FROM pages LEFT JOIN bare b USING (page_id)
"""


def _any_of(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def _count(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in words) + ")"


_NAME_CASE, _ALIAS_CASE = (
    "CASE lang " + " ".join(f"WHEN '{key}' THEN '{pair[i]}'" for key, pair in NAMES.items()) + " END" for i in (0, 1)
)

SNIPPETS_SQL = f"""
named AS (SELECT *, {_NAME_CASE} AS name, {_ALIAS_CASE} AS alias FROM documents),
asked AS (
  SELECT doc_id, text, name AS word FROM named UNION ALL SELECT doc_id, text, alias FROM named),
pieces AS (
  SELECT doc_id, word, unnest(string_split(lower(text), word)) AS piece,
    generate_subscripts(string_split(lower(text), word), 1) AS i,
    len(string_split(lower(text), word)) AS n
  FROM asked),
starts AS (
  SELECT doc_id, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, word ORDER BY i)
    + (i - 1) * length(word) AS INTEGER) AS start, i, n FROM pieces),
snippets AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos, start,
    substring(text, greatest(start - {SNIPPET_WINDOW}, 0) + 1,
      start + {SNIPPET_WINDOW} - greatest(start - {SNIPPET_WINDOW}, 0)) AS snippet,
    lang, source, name, alias
  FROM starts JOIN named USING (doc_id) WHERE i < n),
lowered AS (SELECT *, lower(snippet) AS low FROM snippets),
scored AS (
  SELECT *, CAST(contains(low, name) OR contains(low, alias) AS INTEGER) + {_count(TERMS["terms"])}
    + CASE WHEN {_any_of(TERMS["strong_units"])} THEN 2 WHEN {_any_of(TERMS["weak_units"])} THEN 1 ELSE 0 END
    + CAST({_any_of(TERMS["durations"])} AS INTEGER) + 2 * {_count(TERMS["phrases"])}
    - CAST(length(snippet) < {SNIPPET_SHORT} AS INTEGER) AS score
  FROM lowered)
"""


def _top(entity: str) -> str:
    return f"""
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {entity} ORDER BY score DESC, doc_id, pos) AS INTEGER) AS place
  FROM scored QUALIFY place <= {SNIPPET_TOP})
"""


_PROMPT = SNIPPET_PROMPT.replace("\n", "'||chr(10)||'").replace("'t ", "''t ")
for _place, _sql in {"%1$s": "name", "%2$s": "alias", "%3$s": "coalesce(blobs, '')"}.items():
    _PROMPT = _PROMPT.replace(_place, f"'||{_sql}||'")

ORACLE = {
    "html_to_text": PAGE_TEXT_SQL,
    "route_by_suffix": """
SELECT page_id, CASE WHEN url LIKE '%.html' OR url LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS route FROM pages
""",
    "search_flatten": """
SELECT CAST(page_id AS VARCHAR) AS query, regexp_extract(html, '<title>(.*?)</title>', 1) AS name, url,
  html AS snippet, CASE WHEN url LIKE 'https%' THEN concat('License ', page_id) ELSE '' END AS license_name,
  CASE WHEN url LIKE 'https%' THEN url ELSE '' END AS license_url
FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 'second', url, NULL, '', '' FROM pages
""",
    "snippet_windows": f"WITH {SNIPPETS_SQL} SELECT doc_id, pos, start, snippet FROM snippets",
    "snippet_score": f"WITH {SNIPPETS_SQL} SELECT doc_id, pos, score FROM scored",
    "topk_snippets": f"""
WITH {SNIPPETS_SQL}, {_top("source")} SELECT source, place, doc_id, pos, score, snippet FROM top
""",
    "snippet_prompt": f"""
WITH {SNIPPETS_SQL}, {_top("lang")},
blobs AS (SELECT lang, string_agg(snippet, chr(10) || chr(10) ORDER BY place) AS blobs FROM top GROUP BY lang)
SELECT lang, '"' || name || '" "acute" "inhalation" "LC50" "ppm"' AS query, '{_PROMPT}' AS prompt
FROM (SELECT DISTINCT lang, name, alias FROM named) LEFT JOIN blobs USING (lang)
""",
}
