"""The registered queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import chat_digests, format_chats
from .common import on_workers
from .decontaminate import mark_contaminated
from .jaccard import jaccard_components
from .language import identify, training_texts
from .packing import pack
from .periodic import periodic_runs, planted, run_digests
from .pii import replace_pii
from .quality import judge_quality
from .sharding import shards
from .simhash import near_duplicates
from .spelling import misspelt, spelling_variants
from .token_counts import token_counts
from .urls import filter_urls, labelled_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register ``fn(table, folder) -> DataFrame`` over one table of a scale folder."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(on_workers(spark).read.parquet(f"{folder}/{table}.parquet"), folder)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
norm AS (SELECT DISTINCT r, array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') AS line FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
size AS (SELECT host, count(DISTINCT row(doc_id, text)) AS docs FROM d GROUP BY host),
above AS (SELECT host, line FROM norm JOIN d USING (r) JOIN size USING (host) GROUP BY host, line, docs HAVING count(DISTINCT row(doc_id, text)) > least(1000, greatest(20, 0.005 * docs))),
kept AS (
  SELECT r, sum(len(string_split(line, ' '))) AS line_words, sum(CASE WHEN above.line IS NULL THEN len(string_split(line, ' ')) ELSE 0 END) AS words_left
  FROM norm JOIN d USING (r) LEFT JOIN above USING (host, line) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(line_words, 0) AS line_words, coalesce(words_left, 0) AS words_left
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN kept USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, line_words::BIGINT AS line_words, words_left::BIGINT AS words_left,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.5 * line_words AS kept
FROM m
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS o FROM e UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(min(r.o), d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""


@query("op1_language_id")
def op1(docs: DataFrame, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    training = training_texts(docs.filter(~held_out))
    told = identify(docs, training)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op2_decontamination")
def op2(docs: DataFrame, folder: str) -> DataFrame:
    items = docs.sparkSession.read.parquet(f"{folder}/benchmark.parquet")
    marked = mark_contaminated(docs, items)
    nearest = F.array_min(F.col("hits.distance"))
    return marked.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"), nearest.alias("distance"), (F.size("hits") == 0).alias("kept"))


@query("op3_pii")
def op3(docs: DataFrame, folder: str) -> DataFrame:
    return replace_pii(docs, key="threadloom surrogates")


@query("op4_packing")
def op4(docs: DataFrame, folder: str) -> DataFrame:
    return pack(docs)


@query("op5_token_counts")
def op5(docs: DataFrame, folder: str) -> DataFrame:
    return token_counts(docs)


@query("op6_quality", sql=QUALITY_SQL)
def op6(docs: DataFrame, folder: str) -> DataFrame:
    return judge_quality(docs)


@query("op7_simhash")
def op7(docs: DataFrame, folder: str) -> DataFrame:
    return near_duplicates(docs)


@query("op8_chat", "conversations")
def op8(turns: DataFrame, folder: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(more)))


@query("op9_url_filter", "pages")
def op9(pages: DataFrame, folder: str) -> DataFrame:
    return filter_urls(pages, labelled_urls(pages.sparkSession))


@query("op10_sharding")
def op10(docs: DataFrame, folder: str) -> DataFrame:
    return shards(docs)


@query("op11_periodic_runs")
def op11(docs: DataFrame, folder: str) -> DataFrame:
    return run_digests(periodic_runs(docs, prepare=planted))


@query("op12_spelling_variants")
def op12(docs: DataFrame, folder: str) -> DataFrame:
    return spelling_variants(docs, prepare=misspelt)


@query("op13_jaccard_join", sql=JACCARD_SQL)
def op13(docs: DataFrame, folder: str) -> DataFrame:
    return jaccard_components(docs)
