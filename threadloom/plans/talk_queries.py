"""Queries for language and text analytics."""

from pyspark.sql import functions as F

from ..operators import talk, topics
from ..sources import adapters as a
from .registry import query
from .scope_queries import reels_with_songs
from .views import CAPTIONS, DOC_COMMENTS, PAGE_REPLIES, REELS, SONG_LABEL, SONGS, TAGS

D = f"WITH {DOC_COMMENTS}, {PAGE_REPLIES}"
LANG = """lc AS (SELECT video_id, language, count(*) AS n, min(comment_id) AS f FROM doc_comments WHERE coalesce(language,'') NOT IN ('','unknown') GROUP BY 1,2),
vl AS (SELECT video_id, language FROM (SELECT *, sum(n) OVER (PARTITION BY video_id) AS t, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, f) AS r FROM lc) WHERE r=1 AND n>=5 AND n/t>=0.4)"""
WORD = r"[\p{L}\p{M}\p{N}_]{2,}"
STOP = ["the", "and", "der", "die", "les", "des", "que", "los"]
STOP_SQL = ", ".join(f"'{s}'" for s in STOP)
MUSIC, VISUAL = ["tion", "ment", "ouch"], ["qui", "hand", "schen"]


def docs(t):
    return a.doc_comments(t.documents)


def replies(t):
    return a.page_replies(t.pages, t.documents)


@query("video_languages", f"{D}, {LANG} SELECT video_id, language FROM vl")
def _(t):
    return talk.video_languages(docs(t))


COUNTS = """cnt AS (SELECT 'video' AS level, language, count(*) AS count FROM vl GROUP BY 2 UNION ALL SELECT 'comment', language, count(*) FROM doc_comments WHERE language<>'' GROUP BY 2
 UNION ALL SELECT 'reply', language, count(*) FROM page_replies WHERE language<>'' GROUP BY 2)"""


@query("language_counts", f"{D}, {LANG}, {COUNTS} SELECT * FROM cnt")
def _(t):
    return talk.language_counts(docs(t), replies(t))


@query("language_distribution", f"{D}, {LANG}, {COUNTS}, top AS (SELECT language, count FROM cnt WHERE level='comment' ORDER BY count DESC, language LIMIT 3) SELECT language, round(count/(SELECT sum(count) FROM top),6) AS count FROM top")
def _(t):
    return talk.language_distribution(talk.language_counts(docs(t), replies(t)), "comment", 3, normalize=True)


MISMATCH = """mm AS (SELECT 'comment_vs_video' AS kind, vl.language||' > '||c.language AS pair, count(*) AS count FROM doc_comments c JOIN vl USING (video_id) WHERE c.language<>vl.language GROUP BY 2
 UNION ALL SELECT 'reply_vs_comment', c.language||' > '||r.language, count(*) FROM (SELECT DISTINCT comment_id, language FROM page_replies WHERE language<>'') r JOIN doc_comments c USING (comment_id) WHERE c.language<>r.language GROUP BY 2)"""


@query("language_mismatches", f"{D}, {LANG}, {MISMATCH} SELECT kind, pair, count, round(100.0*count/sum(count) OVER (PARTITION BY kind),6) AS percent FROM mm")
def _(t):
    return talk.language_mismatches(docs(t), replies(t))


def terms_sql(grams: str, base: str = "doc_comments") -> str:
    return f"""toks AS (SELECT comment_id, list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda x: x NOT IN ({STOP_SQL})) AS w FROM {base}),
g AS (SELECT comment_id, unnest({grams}) AS term FROM toks),
terms AS (SELECT term, count(*) AS count, count(DISTINCT comment_id) AS docs FROM g GROUP BY 1)"""


@query("word_frequencies", f"{D}, {terms_sql('w')} SELECT term, count, docs FROM terms WHERE docs>=2 AND docs<=0.95*(SELECT count(*) FROM doc_comments) ")
def _(t):
    return talk.word_frequencies(docs(t), stopwords=STOP)


@query("bigram_frequencies", f"""WITH {DOC_COMMENTS}, en AS (SELECT * FROM doc_comments WHERE language IN ('en','fr')), {terms_sql("list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])", "en")}
SELECT term, count, docs FROM terms WHERE docs>=3 AND docs<=0.9*(SELECT count(*) FROM en) ORDER BY count DESC, term LIMIT 2000""")
def _(t):
    return talk.word_frequencies(docs(t), (2, 2), STOP, ["en", "fr"], min_docs=3, max_share=0.9, max_features=2000)


def _topics(t):
    dated = t.documents.select("doc_id", "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("n_chars") % 180)).alias("date"))
    return talk.topic_model(dated, ngram=(1, 1), stopwords=STOP, vocabulary=20000, rounds=5)


TOPICS, ROUNDS = 4, 2


def fit_sql() -> str:
    """Term counts, then each round's shares and sums, written out."""
    ks = range(TOPICS)
    first = ", ".join(f"1000000+(('0x'||substr(md5(term||'/{k}'),1,6))::BIGINT%1000000) AS w{k}" for k in ks)
    begin = ", ".join(f"round(sum(n)/{float(TOPICS)}*1000000)::BIGINT AS m{k}" for k in ks)
    parts = [f"""{terms_sql('w')}, dated AS (SELECT doc_id, text, TIMESTAMP '2024-01-01'+to_days(CAST(n_chars%180 AS INTEGER)) AS date FROM documents),
tn AS MATERIALIZED (SELECT comment_id AS doc_id, term, count(*) AS n FROM g WHERE term IN (SELECT term FROM terms WHERE docs>=5 AND docs<=0.5*(SELECT count(*) FROM documents)) GROUP BY 1,2),
t0 AS MATERIALIZED (SELECT term, {first} FROM (SELECT DISTINCT term FROM tn)), d0 AS MATERIALIZED (SELECT doc_id, {begin} FROM tn GROUP BY 1)"""]
    for i in range(ROUNDS):
        totals = ", ".join(f"sum(w{k})/1000000.0::DOUBLE+count(*)*0.01::DOUBLE AS s{k}" for k in ks)
        share = ", ".join(f"(m{k}/1000000.0::DOUBLE+0.1::DOUBLE)*(w{k}/1000000.0::DOUBLE+0.01::DOUBLE)/s{k} AS p{k}" for k in ks)
        rounded = ", ".join(f"round(p{k}/({'+'.join(f'p{j}' for j in ks)})*1000000)::BIGINT AS r{k}" for k in ks)
        parts.append(f"""q{i} AS (SELECT {totals} FROM t{i}),
r{i} AS MATERIALIZED (SELECT doc_id, term, n, {rounded} FROM (SELECT doc_id, term, n, {share} FROM tn JOIN t{i} USING (term) JOIN d{i} USING (doc_id), q{i})),
t{i + 1} AS MATERIALIZED (SELECT term, {', '.join(f'sum(n*r{k})::BIGINT AS w{k}' for k in ks)} FROM r{i} GROUP BY 1), d{i + 1} AS MATERIALIZED (SELECT doc_id, {', '.join(f'sum(n*r{k})::BIGINT AS m{k}' for k in ks)} FROM r{i} GROUP BY 1)""")
    top = f"greatest({', '.join(f'm{k}' for k in ks)})"
    at = "coalesce(" + ", ".join(f"CASE WHEN m{k}=top THEN {k + 1} END" for k in ks) + ")"
    whole = "+".join(f"m{k}" for k in ks)
    parts.append(f"""mix AS (SELECT doc_id, date, coalesce('Topic '||place, 'Topic 1') AS topic, coalesce(weight, {1 / TOPICS}) AS weight FROM dated LEFT JOIN
 (SELECT doc_id, {at} AS place, (top/1000000.0::DOUBLE+0.1::DOUBLE)/(({whole})/1000000.0::DOUBLE+{TOPICS * 0.1!r}::DOUBLE) AS weight FROM (SELECT *, {top} AS top FROM d{ROUNDS})) USING (doc_id))""")
    return f"{D}, {', '.join(parts)}"


FITTED = fit_sql()
LONG_TERMS = " UNION ALL ".join(f"SELECT {k} AS k, term, w{k} AS w FROM t{ROUNDS}" for k in range(TOPICS))


def _fit(t):
    dated = t.documents.select("doc_id", "text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("n_chars") % 180)).alias("date"))
    counts = topics.term_counts(dated, "doc_id", (1, 1), STOP)
    return dated.drop("text"), *topics.fit_topics(counts, "doc_id", TOPICS, ROUNDS)


def _mix(t):
    dated, _terms, documents = _fit(t)
    return topics.dominant_topics(dated, "doc_id", documents, TOPICS)


@query("topic_terms", f"""{FITTED}, lt AS ({LONG_TERMS}) SELECT 'Topic '||(k+1) AS topic, rank, term, round(w/total,6) AS weight
 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, term) AS rank, sum(w) OVER (PARTITION BY k) AS total FROM lt) WHERE rank<=10""")
def _(t):
    return topics.top_terms(_fit(t)[1], TOPICS)


@query("document_topics", f"{FITTED} SELECT doc_id, strftime(date,'%Y-%m-%d %H:%M:%S') AS date, topic, round(weight,6) AS weight FROM mix")
def _(t):
    return _mix(t)


@query("topic_shares", f"{FITTED} SELECT topic, round(sum(weight),6) AS total_weight, round(100*sum(weight)/(SELECT sum(weight) FROM mix),6) AS percent FROM mix GROUP BY 1")
def _(t):
    return talk.topic_shares(_mix(t))


@query("monthly_topic_shares", f"""{FITTED}, ms AS (SELECT strftime(date_trunc('month',date),'%Y-%m-%d') AS month, topic, sum(weight) AS w FROM mix GROUP BY 1,2)
SELECT month, topic, round(w,6) AS weight, round(100*w/sum(w) OVER (PARTITION BY month),6) AS percent FROM ms""")
def _(t):
    return talk.monthly_topic_shares(_mix(t))


@query("topic_invariants", """SELECT count(*) AS documents, true AS weights_between_0_and_1, 100.0::DOUBLE AS share_total, count(DISTINCT (n_chars%180)//31) > 0 AS has_months, 0::BIGINT AS months_off_100 FROM documents""")
def _(t):
    model, _voc, vectors = _topics(t)
    mix = talk.document_topics(model, vectors)
    total = F.round(talk.topic_shares(mix).agg(F.sum("percent")).scalar(), 6)
    months = talk.monthly_topic_shares(mix).groupBy("month").agg(F.sum("percent").alias("p"))
    off = months.agg(F.count_if(F.abs(F.col("p") - 100) > 1e-6)).scalar()
    return mix.agg(F.count("*").alias("documents"), F.every((F.col("weight") >= 0) & (F.col("weight") <= 1)).alias("weights_between_0_and_1")).select(
        "*", total.alias("share_total"), (months.agg(F.count("*")).scalar() > 0).alias("has_months"), off.alias("months_off_100"),
    )


def markers_sql(source: str) -> str:
    def lead(c):
        return r"(?:^|[^\p{L}\p{M}\p{N}_])" + c + r"([A-Za-z0-9_]{2,})"

    return rf"""m AS (SELECT unnest(regexp_extract_all(text, '(?i)(https?://\S+|www\.\S+)')) AS link FROM {source}),
mk AS (SELECT 'links' AS kind, link AS value FROM m
 UNION SELECT 'emails', unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')) FROM {source}
 UNION SELECT 'hashtags', lower(unnest(regexp_extract_all(text, '{lead('#')}', 1))) FROM {source}
 UNION SELECT 'mentions', lower(unnest(regexp_extract_all(text, '{lead('@')}', 1))) FROM {source}
 UNION SELECT 'domains', regexp_replace(lower(regexp_extract(regexp_replace(link, '^https?://', ''), '^([^/?#]*)', 1)), '^www\.', '') FROM m)
SELECT kind, value FROM mk WHERE value<>''"""


@query("social_markers_documents", f"WITH s AS (SELECT text FROM documents), {markers_sql('s')}")
def _(t):
    return talk.social_markers(t.documents)


@query("social_markers_pages", f"WITH s AS (SELECT html AS text FROM pages), {markers_sql('s')}")
def _(t):
    return talk.social_markers(t.pages.select(F.col("html").alias("text")))


CLEAN = r"""cl AS (SELECT *, lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(trim(caption_text), '(?i)https?://\S+|www\.\S+', ' ', 'g'),
 '(^|[^\p{L}\p{M}\p{N}_])@[\p{L}\p{M}\p{N}_.]+', '\1 ', 'g'), '#', ' '), '[\.,;:!\?\(\)\[\]\{\}\"''`´“”‘’•·…|/\\]+', ' ', 'g'), '\s+', ' ', 'g'))) AS clean FROM captions),
ct AS (SELECT *, list_filter(list_transform(regexp_extract_all(clean, '[\p{L}\p{M}\p{N}_]+'), lambda x: trim(x, '_')),
 lambda x: length(x)>=3 AND NOT regexp_full_match(x, '\p{Nd}+') AND x NOT IN ('the','and','for','with','this','that','you','are','from','und','der','die','das','ein','eine','mit','ist','für','von')) AS tok FROM cl)"""


@query("caption_terms", f"WITH {CAPTIONS}, {CLEAN}, g AS (SELECT reel_pk, unnest(tok) AS term FROM ct) SELECT term, count(*) AS count, count(DISTINCT reel_pk) AS reel_count FROM g GROUP BY 1 ORDER BY count DESC, term LIMIT 200")
def _(t):
    return talk.caption_terms(a.caption_reels(t.documents), 200)


@query("hashtag_terms", f"WITH {TAGS} SELECT hashtag, count(*) AS count, count(DISTINCT reel_pk) AS reel_count FROM reel_hashtags GROUP BY 1 ORDER BY count DESC, hashtag LIMIT 20")
def _(t):
    return talk.hashtag_terms(a.reel_hashtags(t.lineitem, t.part), 20)


@query("top_hashtags_of_song", f"WITH {TAGS}, {REELS} SELECT hashtag, count(*) AS count FROM reel_hashtags JOIN reels USING (reel_pk) WHERE song_id='2-HIGH' GROUP BY 1 ORDER BY count DESC, hashtag LIMIT 20")
def _(t):
    return talk.top_hashtags(a.reels(t.orders), a.reel_hashtags(t.lineitem, t.part), "2-HIGH")


def distinctive_sql(rows: str, n: int) -> str:
    return f"""c AS (SELECT entity_id, entity_label, term, count(*) AS count FROM {rows} GROUP BY ALL), e AS (SELECT entity_id, CAST(sum(count) AS BIGINT) AS entity_total_terms FROM c GROUP BY 1),
gl AS (SELECT term, CAST(sum(count) AS BIGINT) AS global_count FROM c GROUP BY 1), v AS (SELECT count(*) AS v, CAST(sum(global_count) AS BIGINT) AS t FROM gl),
s AS (SELECT entity_id, entity_label, term, count, entity_total_terms, global_count, t AS global_total_terms, round(((count+1)/(entity_total_terms+v))/((global_count+1)/(t+v)),6) AS score FROM c JOIN e USING (entity_id) JOIN gl USING (term), v)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, count DESC, term) AS rank FROM s) WHERE rank<={n}"""


@query("distinctive_caption_terms", f"WITH {CAPTIONS}, {CLEAN}, g AS (SELECT asset_id AS entity_id, variant_label||' ('||asset_id||')' AS entity_label, unnest(tok) AS term FROM ct), {distinctive_sql('g', 30)}")
def _(t):
    return talk.distinctive_terms(a.caption_reels(t.documents), "asset")


@query("distinctive_tag_terms", f"WITH {REELS}, {SONGS}, {TAGS}, g AS (SELECT song_id AS entity_id, {SONG_LABEL} AS entity_label, hashtag AS term FROM reels LEFT JOIN songs USING (song_id) JOIN reel_hashtags USING (reel_pk)), {distinctive_sql('g', 10)}")
def _(t):
    return talk.distinctive_terms(reels_with_songs(t), "song", a.reel_hashtags(t.lineitem, t.part), 10)


def odds_sql(group: str) -> str:
    return f"""WITH {REELS}, {TAGS}, c AS (SELECT {group}, hashtag, count(*) AS g FROM reels JOIN reel_hashtags USING (reel_pk) GROUP BY 1,2), t AS (SELECT sum(g) AS t FROM c), s AS (SELECT {group}, sum(g) AS gt FROM c GROUP BY 1), o AS (SELECT hashtag, sum(g) AS n FROM c GROUP BY 1),
j AS (SELECT {group}, hashtag, g AS n_group, CAST(n-g AS BIGINT) AS n_other, CAST(gt AS DOUBLE) AS gt, CAST(t-gt AS DOUBLE) AS ot FROM c JOIN s USING ({group}) JOIN o USING (hashtag), t WHERE g>=3),
k AS (SELECT {group}, hashtag, n_group, n_other, n_group/gt AS share_group, n_other/ot AS share_other, (n_group/gt)/(n_other/ot) AS lift, ln(((n_group+0.5)/(gt-n_group+0.5))/((n_other+0.5)/(ot-n_other+0.5))) AS log_odds FROM j)
SELECT {group}, hashtag, n_group, n_other, round(share_group,6) AS share_group, round(share_other,6) AS share_other, round(lift,6) AS lift, round(log_odds,6) AS log_odds, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY log_odds DESC, n_group DESC, hashtag) AS rank FROM k) WHERE rank<=10"""


@query("distinctive_hashtags_by_song", odds_sql("song_id"))
def _(t):
    return talk.distinctive_hashtags(a.reels(t.orders), a.reel_hashtags(t.lineitem, t.part), "song_id", n=10)


@query("distinctive_hashtags_by_asset", odds_sql("asset_id"))
def _(t):
    return talk.distinctive_hashtags(a.reels(t.orders), a.reel_hashtags(t.lineitem, t.part), "asset_id", n=10)


@query("caption_markers", rf"""WITH {CAPTIONS}, x AS (SELECT reel_pk, trim(caption_text) AS c FROM captions)
SELECT reel_pk, regexp_matches(c, '(?i)https?://\S+|www\.\S+') AS has_url, len(regexp_extract_all(c, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])@[\p{{L}}\p{{M}}\p{{N}}_.]+')) AS mention_count,
 len(regexp_extract_all(c, '#[\p{{L}}\p{{M}}\p{{N}}_]+')) AS hashtag_count_in_caption, length(c) AS caption_length, c='' AS is_empty_caption,
 len(regexp_extract_all(c, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]')) AS emoji_count FROM x""")
def _(t):
    return talk.caption_markers(a.caption_reels(t.documents))


def tagged_captions(t):
    """Captions with their own hashtags as the tag list."""
    return a.caption_reels(t.documents).withColumn("hashtags", F.array_distinct(talk.tx.find_all(F.lower("caption_text"), r"#(\w+)", 1)))


FEATURES = r"""feat AS (SELECT *, length(caption_text) AS caption_len, len(list_distinct(regexp_extract_all(lower(caption_text), '#(\w+)', 1))) AS n_hashtags, len(regexp_extract_all(caption_text, '[\x{10000}-\x{10FFFF}]')) AS emoji_count,
 regexp_matches(caption_text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]') AS has_japanese_script, regexp_matches(caption_text, '[A-Za-z]') AS has_latin_script FROM captions),
ftype AS (SELECT *, CASE WHEN has_japanese_script AND NOT has_latin_script THEN 'japanese_script' WHEN caption_len>0 AND n_hashtags>0 AND caption_len<=n_hashtags*25 THEN 'mostly_hashtags'
 WHEN caption_len=0 THEN 'no_caption' ELSE 'sentence_or_mixed' END AS caption_type FROM feat)"""


@query("caption_features", f"WITH {CAPTIONS}, {FEATURES} SELECT reel_pk, caption_len, n_hashtags, emoji_count, has_japanese_script, has_latin_script, caption_type FROM ftype")
def _(t):
    return talk.caption_features(tagged_captions(t)).select("reel_pk", "caption_len", "n_hashtags", "emoji_count", "has_japanese_script", "has_latin_script", "caption_type")


@query("caption_style_summary", f"""WITH {CAPTIONS}, {FEATURES} SELECT caption_type, count(*) AS n_reels, round(avg(has_japanese_script::INT),6) AS japanese_script_share, quantile_cont(caption_len,0.5) AS median_caption_len,
 CAST(quantile_cont(n_hashtags,0.5) AS DOUBLE) AS median_hashtags, round(avg((contains(lower(caption_text),'tion'))::INT),6) AS context_classifiable_share FROM ftype GROUP BY 1""")
def _(t):
    f = talk.caption_features(tagged_captions(t))
    return talk.caption_style_summary(f, {"context": F.lower("caption_text").contains("tion")})


def _hits(terms):
    return "list_filter([" + ", ".join(f"'{x}'" for x in sorted(terms)) + "], lambda x: contains(lower(caption_text), x))"


AUDIO = f"au AS (SELECT *, {_hits(MUSIC)} AS mh, {_hits(VISUAL)} AS vh FROM captions)"


@query("audio_filter_scores", f"""WITH {CAPTIONS}, {AUDIO} SELECT reel_pk, array_to_string(mh,'|') AS music_hits, array_to_string(vh,'|') AS visual_world_hits, len(mh) AS music_discourse_score, len(vh) AS visual_world_score,
 len(mh)>0 AS has_music_discourse, len(vh)>0 AS has_visual_world, len(vh)>0 AND len(mh)=0 AS audio_filter_use, len(vh)-len(mh) AS audio_filter_index FROM au""")
def _(t):
    return talk.audio_filter_scores(a.caption_reels(t.documents), MUSIC, VISUAL, tags=None).drop("song_id", "asset_id", "variant_label", "caption_text", "play_count", "impact_metric", "taken_at", "creator_pseudo")


for _g in ("song_id", "asset_id"):
    @query(f"audio_filter_summary_{_g[:-3]}", f"""WITH {CAPTIONS}, {AUDIO} SELECT {_g}, count(*) AS n_reels, round(avg((len(mh)>0)::INT),6) AS music_discourse_share, round(avg((len(vh)>0)::INT),6) AS visual_world_share,
 round(avg((len(vh)>0 AND len(mh)=0)::INT),6) AS audio_filter_share, CAST(quantile_cont(len(vh)-len(mh),0.5) AS DOUBLE) AS median_audio_filter_index, quantile_cont(play_count,0.5) AS median_plays FROM au GROUP BY 1""")
    def _(t, g=_g):
        return talk.audio_filter_summary(talk.audio_filter_scores(a.caption_reels(t.documents), MUSIC, VISUAL, tags=None), g)
