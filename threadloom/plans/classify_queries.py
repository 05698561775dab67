"""Queries for classification, samples, churn and agreement."""

from pyspark.sql import functions as F

from ..operators import classify, longitudinal as lo, talk
from ..sources import adapters as a
from .registry import query
from .scope_queries import reels_with_songs
from .talk_queries import FEATURES, tagged_captions
from .views import ACOUSTICS, ANNOTATIONS, CAPTIONS, CRAWLS, REELS, SONG_LABEL, SONGS

RULES = {
    "context": {
        "categories": {
            "city": {"label": "City", "keywords": ["tion"]},
            "nature": {"label": "Nature", "keywords": ["eau", "schen"]},
            "home": {"label": "Home", "keywords": ["hand", "ado"]},
        },
        "unknown_id": "context_unknown", "unknown_label": "Unknown context",
    },
    "format": {
        "categories": {
            "talk": {"label": "Talk", "keywords": ["qui"]},
            "dance": {"label": "Dance", "keywords": ["lich", "keit"]},
            "text": {"label": "Text", "keywords": ["ouch", "license"]},
        },
        "unknown_id": "format_unknown", "unknown_label": "Unknown format",
    },
    "aesthetic": {
        "categories": {"bright": {"label": "Bright", "keywords": ["zz"]}, "dark": {"label": "Dark", "keywords": ["aux"]}},
        "unknown_id": "aesthetic_unknown", "unknown_label": "Unknown look",
    },
}
INFERENCE = [{"if_context_any": ["city"], "and_format_any": ["dance"], "add_aesthetic": "dark"}, {"if_context_any": ["home"], "add_aesthetic": "bright"}]
ADJACENCY = {"context": {("city", "home"): 0.5, ("nature", "home"): 0.25}}
SOURCES = ("keyword", "vision")


def hits_sql(dim: str) -> str:
    parts = []
    for c, s in RULES[dim]["categories"].items():
        cond = " OR ".join(f"contains(lower(caption_text),'{k}')" for k in s["keywords"])
        parts.append(f"CASE WHEN {cond} THEN '{c}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def unk(dim: str) -> str:
    return f"['{RULES[dim]['unknown_id']}']"


def label_sql(dim: str, c: str) -> str:
    spec = RULES[dim]
    whens = " ".join(f"WHEN '{k}' THEN '{v['label']}'" for k, v in spec["categories"].items())
    return f"CASE {c} {whens} WHEN '{spec['unknown_id']}' THEN '{spec['unknown_label']}' ELSE {c} END"


def _or(dim, expr):
    return f"CASE WHEN len({expr})>0 THEN {expr} ELSE {unk(dim)} END"


CL = f"""{CAPTIONS}, {ANNOTATIONS},
vis AS (SELECT reel_pk, list_sort(list(DISTINCT category) FILTER (dimension='context')) AS cv, list_sort(list(DISTINCT category) FILTER (dimension='format')) AS fv FROM annotations WHERE source='vision' AND confidence>=0.2 GROUP BY 1),
h AS (SELECT c.*, {hits_sql('context')} AS ck, {hits_sql('format')} AS fk, {hits_sql('aesthetic')} AS ak, coalesce(cv,[]) AS cv, coalesce(fv,[]) AS fv FROM captions c LEFT JOIN vis USING (reel_pk)),
h2 AS (SELECT *, list_sort(list_distinct(list_concat(ck,cv))) AS cf, list_sort(list_distinct(list_concat(fk,fv))) AS ff, list_sort(ak) AS af FROM h),
h3 AS (SELECT *, {_or('context','cf')} AS context_categories, {_or('format','ff')} AS format_categories,
 list_sort(list_distinct(list_filter([CASE WHEN list_contains(cf,'city') AND list_contains(ff,'dance') THEN 'dark' END, CASE WHEN list_contains(cf,'home') THEN 'bright' END], lambda x: x IS NOT NULL))) AS inf FROM h2),
cl AS (SELECT *, CASE WHEN len(af)>0 THEN af WHEN len(inf)>0 THEN inf ELSE {unk('aesthetic')} END AS aesthetic_categories FROM h3)"""


def classified(t):
    return classify.classify(a.caption_reels(t.documents), RULES, a.annotations(t.labels), SOURCES, 0.2, INFERENCE, tags=None)


@query("keyword_categories", f"WITH {CAPTIONS}, h AS (SELECT reel_pk, {hits_sql('context')} AS ck FROM captions) SELECT reel_pk, array_to_string({_or('context','ck')}, '|') AS context FROM h")
def _(t):
    return a.caption_reels(t.documents).select("reel_pk", classify.keyword_categories(talk.theme_text(tags=None), RULES, "context").alias("context"))


@query("classified_reels", f"""WITH {CL} SELECT reel_pk, array_to_string(context_categories,'|') AS context_categories, array_to_string(format_categories,'|') AS format_categories,
 array_to_string(aesthetic_categories,'|') AS aesthetic_categories, array_to_string({_or('context','ck')},'|') AS context_keyword, array_to_string(cv,'|') AS context_vision FROM cl""")
def _(t):
    return classified(t).select("reel_pk", "context_categories", "format_categories", "aesthetic_categories", "context_keyword", "context_vision")


@query("dimension_rows", f"WITH {CL} SELECT reel_pk, unnest(format_categories) AS format FROM cl")
def _(t):
    return classify.explode_dimension(classified(t), "format").select("reel_pk", "format")


for _d in RULES:
    @query(f"dimension_distribution_{_d}", f"""WITH {CL}, e AS (SELECT song_id, unnest(list_distinct({_d}_categories)) AS category FROM cl), n AS (SELECT song_id, count(*) AS n FROM cl GROUP BY 1)
SELECT song_id, '{_d}' AS dimension, category, {label_sql(_d, 'category')} AS label, count(*) AS count, round(count(*)/min(n),6) AS share FROM e JOIN n USING (song_id) GROUP BY song_id, category""")
    def _(t, d=_d):
        return classify.dimension_distribution(classified(t), RULES, d)

    @query(f"distribution_classifiable_{_d}", f"""WITH {CL}, k AS (SELECT * FROM cl WHERE list_distinct({_d}_categories)<>{unk(_d)}), e AS (SELECT unnest(list_distinct({_d}_categories)) AS category FROM k)
SELECT category, {label_sql(_d, 'category')} AS label, count(*) AS count, round(count(*)/(SELECT count(*) FROM k),6) AS share_of_classifiable FROM e WHERE category<>{unk(_d)}[1] GROUP BY 1""")
    def _(t, d=_d):
        return classify.distribution_classifiable(classified(t), RULES, d)


def _per_dim(fmt: str) -> str:
    return " UNION ALL ".join(fmt.format(d=d, u=unk(d)) for d in RULES)


@query("unknown_share", f"WITH {CL} " + _per_dim("SELECT '{d}' AS dimension, count(*) FILTER ({d}_categories={u}) AS unknown_only, count(*) AS total, round(count(*) FILTER ({d}_categories={u})/count(*),6) AS share FROM cl"))
def _(t):
    return classify.unknown_share(classified(t), RULES)


@query("classifiable_rate", f"WITH {CL} " + _per_dim("SELECT '{d}' AS dimension, count(*) AS n_total, count(*) FILTER ({d}_categories<>{u}) AS n_classifiable, round(count(*) FILTER ({d}_categories<>{u})/count(*),6) AS rate FROM cl"))
def _(t):
    return classify.classifiable_rate(classified(t), RULES)


@query("combination_summary", f"""WITH {CL}, e AS (SELECT song_id, reel_pk, impact_metric, unnest(context_categories) AS context, format_categories FROM cl), e2 AS (SELECT song_id, reel_pk, impact_metric, context, unnest(format_categories) AS format FROM e)
SELECT context, format, count(*) AS reels, count(DISTINCT song_id) AS songs, quantile_cont(impact_metric,0.5) AS median_impact, {label_sql('context','context')}||' + '||{label_sql('format','format')} AS combo_label
FROM e2 GROUP BY context, format ORDER BY reels DESC, context, format LIMIT 25""")
def _(t):
    return classify.combination_summary(classified(t), RULES, "context", "format")


def shares_sql(dim: str, keys: str) -> str:
    clf = f"{dim}_categories<>{unk(dim)}"
    cols = ", ".join(f"coalesce(count(*) FILTER ({clf} AND list_contains({dim}_categories,'{c}'))/nullif(count(*) FILTER ({clf}),0),0) AS {c}" for c in RULES[dim]["categories"])
    return f"SELECT {keys}, count(*) AS n_total, count(*) FILTER ({clf}) AS n_classifiable, {cols}"


CTX = ("city", "nature", "home")


@query("song_profile", f"WITH {CL}, p AS ({shares_sql('context','song_id')} FROM cl GROUP BY 1) SELECT song_id, n_total, n_classifiable, {', '.join(f'round({c},6) AS {c}' for c in CTX)} FROM p")
def _(t):
    return classify.song_profile(classified(t), RULES, "context")


LONGP = f"p AS ({shares_sql('context','song_id')} FROM cl GROUP BY 1), l AS (SELECT song_id, category, share FROM p UNPIVOT (share FOR category IN (city, nature, home)))"


@query("song_distinctiveness", f"WITH {CL}, {LONGP} SELECT category, round(min(share),3) AS min, round(max(share),3) AS max, round(max(share)-min(share),3) AS range, (list(song_id ORDER BY share DESC, song_id))[1] AS strongest_song FROM l GROUP BY 1")
def _(t):
    return classify.song_distinctiveness(classified(t), RULES, "context")


@query("theme_heat", f"WITH {CL}, {LONGP} SELECT song_id, category, round(share,6) AS share FROM l WHERE category IN (SELECT category FROM l GROUP BY 1 HAVING max(share)>=0.5)")
def _(t):
    return classify.theme_heat(classified(t), RULES, threshold=0.5)


@query("top_examples", f"WITH {CL} SELECT reel_pk, impact_metric, row_number() OVER (ORDER BY impact_metric DESC, reel_pk) AS rank FROM cl WHERE list_contains(format_categories,'dance') ORDER BY impact_metric DESC, reel_pk LIMIT 5")
def _(t):
    return classify.top_examples(classified(t), "format", "dance").select("reel_pk", "impact_metric", "rank")


ASSETP = f"ap AS ({shares_sql('context','song_id, asset_id, variant_label')}, count(DISTINCT creator_pseudo) AS creators, quantile_cont(play_count,0.5) AS median_plays, quantile_cont(impact_metric,0.5) AS median_impact, min(taken_at) AS f, max(taken_at) AS l FROM cl GROUP BY 1,2,3)"


@query("asset_profile", f"""WITH {CL}, {ASSETP} SELECT song_id, asset_id, variant_label, n_total, n_classifiable, creators, median_plays, median_impact, strftime(f,'%Y-%m-%d %H:%M:%S') AS first_date, strftime(l,'%Y-%m-%d %H:%M:%S') AS last_date,
 {', '.join(f'round({c},6) AS {c}' for c in CTX)} FROM ap""")
def _(t):
    return classify.asset_profile(classified(t), RULES)


@query("asset_vs_song", f"""WITH {CL}, {ASSETP}, {LONGP}, d AS (SELECT ap.song_id, asset_id, variant_label, ap.n_total, abs(ap.city-p.city) AS d1, abs(ap.nature-p.nature) AS d2, abs(ap.home-p.home) AS d3 FROM ap JOIN p USING (song_id))
SELECT song_id, asset_id, variant_label, n_total, round(d1+d2+d3,6) AS delta_sum, CASE greatest(d1,d2,d3) WHEN d1 THEN 'City' WHEN d2 THEN 'Nature' ELSE 'Home' END AS strongest_difference, round(greatest(d1,d2,d3),6) AS strongest_abs_delta FROM d""")
def _(t):
    return classify.asset_vs_song(classified(t), RULES)


@query("top_quantile_flags", f"WITH {REELS}, q AS (SELECT song_id, quantile_cont(impact_metric,0.9) AS q FROM reels GROUP BY 1) SELECT reel_pk, impact_metric>=q AS is_top_quantile FROM reels JOIN q USING (song_id)")
def _(t):
    return classify.top_quantile_flag(a.reels(t.orders)).select("reel_pk", "is_top_quantile")


@query("impact_by_theme", f"""WITH {CL}, q AS (SELECT song_id, quantile_cont(impact_metric,0.9) AS q FROM cl GROUP BY 1), f AS (SELECT cl.*, impact_metric>=q AS top FROM cl JOIN q USING (song_id)), c AS (SELECT unnest(['city','nature','home']) AS category),
g AS (SELECT song_id, category, count(*) FILTER (top) AS n_top, count(*) FILTER (NOT top) AS n_rest, coalesce(avg(list_contains(context_categories,category)::INT) FILTER (top),0) AS st, coalesce(avg(list_contains(context_categories,category)::INT) FILTER (NOT top),0) AS sr FROM f, c GROUP BY 1,2)
SELECT song_id, 'context' AS dimension, category, {label_sql('context','category')} AS label, n_top, n_rest, round(st,6) AS share_top, round(sr,6) AS share_rest, round(st-sr,6) AS delta FROM g""")
def _(t):
    return classify.impact_by_theme(classified(t), RULES)


CREATORS = f"""cs AS (SELECT creator_pseudo, count(DISTINCT reel_pk) AS n_reels, count(DISTINCT song_id) AS n_songs, count(DISTINCT asset_id) AS n_assets, CAST(coalesce(sum(play_count),0) AS BIGINT) AS total_plays,
 quantile_cont(play_count,0.5) AS median_plays FROM reels GROUP BY 1)"""


@query("creator_summary", f"WITH {REELS}, {CREATORS} SELECT * FROM cs")
def _(t):
    return classify.creator_summary(a.reels(t.orders))


@query("creator_kpis", f"""WITH {REELS}, {CREATORS}, p AS (SELECT *, row_number() OVER (ORDER BY n_reels DESC, creator_pseudo) AS place FROM cs), k AS (SELECT greatest(1, round_even(count(*)*0.01, 0)) AS k FROM cs), n AS (SELECT count(DISTINCT reel_pk) AS n FROM reels)
SELECT 'creators' AS metric, count(*)::DOUBLE AS value FROM p UNION ALL SELECT 'reels', n::DOUBLE FROM n UNION ALL SELECT 'one_time_creator_share', round(avg((n_reels=1)::INT),6) FROM p
UNION ALL SELECT 'creators_with_multiple_songs', count(*) FILTER (n_songs>1)::DOUBLE FROM p UNION ALL SELECT 'top_1pct_share_reels', round(sum(n_reels)/(SELECT n FROM n),6) FROM p WHERE place<=(SELECT k FROM k)
UNION ALL SELECT 'top_1pct_share_plays', round(sum(total_plays) FILTER (place<=(SELECT k FROM k))/sum(total_plays),6) FROM p""")
def _(t):
    return classify.creator_kpis(a.reels(t.orders))


@query("multi_song_creators", f"WITH {REELS}, {CREATORS} SELECT * FROM cs WHERE n_songs>=4")
def _(t):
    return classify.multi_song_creators(a.reels(t.orders), 4)


FAM = f"""{ACOUSTICS}, m AS (SELECT quantile_cont(tempo,0.5) AS tm, quantile_cont(spectral_centroid,0.5) AS cm, stddev_pop(tempo) AS ts, stddev_pop(spectral_centroid) AS cs FROM acoustics),
fam AS (SELECT asset_id, song_id, CASE WHEN spectral_centroid>=cm THEN 'bright' ELSE 'warm' END||'-'||CASE WHEN tempo>=tm THEN 'fast' ELSE 'slow' END AS family,
 round(greatest(0.4,least(1.0,0.4+(abs((tempo-tm)/ts)+abs((spectral_centroid-cm)/cs))/8)),3) AS confidence FROM acoustics, m)"""


@query("acoustic_families", f"WITH {FAM} SELECT asset_id, family, confidence FROM fam")
def _(t):
    return classify.acoustic_families(a.acoustics(t.embeddings))


@query("acoustic_family_reels", f"WITH {FAM}, r AS (SELECT printf('a%06d', doc_id%500) AS asset_id FROM documents) SELECT family, count(*) AS reels FROM r JOIN fam USING (asset_id) GROUP BY 1")
def _(t):
    reels = t.documents.select(F.format_string("a%06d", F.col("doc_id") % 500).alias("asset_id"))
    return classify.family_counts(classify.acoustic_families(a.acoustics(t.embeddings)), reels)


def tag_scores(t):
    """Vector elements as category scores."""
    e = F.posexplode("embedding").alias("i", "x")
    return t.embeddings.select("vec_id", e).select(
        F.col("vec_id").alias("reel_pk"), F.concat(F.lit("d"), F.col("i") % 2).alias("dimension"), F.format_string("c%02d", "i").alias("category"), F.round(F.col("x").cast("double") * 4, 4).alias("score")
    )


@query("chosen_tags", """WITH s AS (SELECT vec_id AS reel_pk, i, embedding[i+1]::DOUBLE AS x FROM embeddings, range(0,64) r(i)), c AS (SELECT reel_pk, 'd'||(i%2) AS dimension, printf('c%02d', i) AS category, round(x*4,4) AS score FROM s),
b AS (SELECT *, max(score) OVER (PARTITION BY reel_pk, dimension) AS best FROM c)
SELECT reel_pk, dimension, category, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY reel_pk, dimension ORDER BY score DESC, category) AS rank FROM b WHERE score>=0.15 AND (best<=0 OR score>=0.4*best)) WHERE rank<=2""")
def _(t):
    return classify.choose_tags(tag_scores(t))


@query("timeline_matrix", f"""WITH {REELS}, {SONGS}, r AS (SELECT strftime(taken_at,'%Y-%m') AS period, {SONG_LABEL} AS label FROM reels LEFT JOIN songs USING (song_id)),
b AS (SELECT label FROM r GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 3)
SELECT period, count(*) FILTER (label=(SELECT label FROM b ORDER BY label LIMIT 1)) AS c1, count(*) FILTER (label=(SELECT label FROM b ORDER BY label LIMIT 1 OFFSET 1)) AS c2, count(*) FILTER (label=(SELECT label FROM b ORDER BY label LIMIT 1 OFFSET 2)) AS c3
FROM r WHERE label IN (SELECT label FROM b) GROUP BY 1""")
def _(t):
    from ..operators import scope

    m = classify.timeline_matrix(scope.timeline(reels_with_songs(t)), 3)
    return m.toDF("period", *[f"__{c}" for c in m.columns[1:]]).select("period", *[F.col(f"`__{c}`").alias(f"c{i}") for i, c in enumerate(sorted(m.columns[1:]), 1)])


@query("report_song_summary", f"""WITH {REELS} SELECT song_id, count(*) AS n_reels, strftime(min(taken_at),'%Y-%m-%d') AS "from", strftime(max(taken_at),'%Y-%m-%d') AS "to",
 quantile_cont(play_count,0.5) AS median_plays, quantile_cont(like_count,0.5) AS median_likes, round(quantile_cont(engagement_rate,0.5),4) AS median_engagement FROM reels GROUP BY 1""")
def _(t):
    tags = a.reel_hashtags(t.lineitem, t.part)
    grouped = tags.groupBy("reel_pk").agg(F.sort_array(F.collect_set("hashtag")).alias("hashtags"))
    rules = {"context": {"categories": {"promo": {"keywords": ["promo"]}, "small": {"keywords": ["small", "medium"]}}, "unknown_id": "none", "unknown_label": "None"}}
    reels = reels_with_songs(t).join(grouped, "reel_pk", "left").withColumn("caption_text", F.lit(""))
    return classify.report_tables(classify.classify(reels, rules), rules, tags, only=["summary"])["summary"]


@query("caption_style_classified", f"""WITH {CL}, feat0 AS (SELECT * FROM cl), {FEATURES.replace('FROM captions', 'FROM feat0')}
SELECT caption_type, count(*) AS n_reels, round(avg(has_japanese_script::INT),6) AS japanese_script_share, {', '.join(f"round(avg(({d}_categories<>{unk(d)})::INT),6) AS {d}_classifiable_share" for d in RULES)},
 quantile_cont(caption_len,0.5) AS median_caption_len, CAST(quantile_cont(n_hashtags,0.5) AS DOUBLE) AS median_hashtags FROM ftype GROUP BY 1""")
def _(t):
    f = talk.caption_features(classified(t).join(tagged_captions(t).select("reel_pk", "hashtags"), "reel_pk"))
    return talk.caption_style_summary(f, {d: F.col(f"{d}_categories") != F.array(F.lit(RULES[d]["unknown_id"])) for d in RULES})


# churn -----------------------------------------------------------------------

CHURN = f"""{CRAWLS}, steps AS (SELECT crawl_id AS f, lead(crawl_id) OVER (ORDER BY started_at, crawl_id) AS n FROM runs), st AS (SELECT * FROM steps WHERE n IS NOT NULL),
b AS (SELECT f, n, asset_id, reel_pk, song_id FROM seen JOIN st ON crawl_id=f), af AS (SELECT f, n, asset_id, reel_pk, song_id FROM seen JOIN st ON crawl_id=n),
j AS (SELECT coalesce(b.f,af.f) AS from_crawl, coalesce(b.n,af.n) AS to_crawl, coalesce(b.asset_id,af.asset_id) AS asset_id, coalesce(af.song_id,b.song_id) AS song_id, b.reel_pk AS p, af.reel_pk AS c FROM b FULL JOIN af ON b.f=af.f AND b.asset_id=af.asset_id AND b.reel_pk=af.reel_pk),
ch AS (SELECT from_crawl, to_crawl, asset_id, min(song_id) AS song_id, count(p) AS n_from, count(c) AS n_to, count(*) FILTER (p IS NOT NULL AND c IS NOT NULL) AS retained, count(*) FILTER (p IS NULL) AS new, count(*) FILTER (c IS NULL) AS lost,
 count(*) FILTER (p IS NOT NULL AND c IS NOT NULL)/nullif(count(p),0) AS retention_rate, count(*) FILTER (p IS NULL)/nullif(count(c),0) AS new_rate FROM j GROUP BY 1,2,3)"""
INTERVALS = """iv AS (SELECT substr(from_crawl,1,4)||'-'||substr(from_crawl,5,2)||'-'||substr(from_crawl,7,2) AS from_date, substr(to_crawl,1,4)||'-'||substr(to_crawl,5,2)||'-'||substr(to_crawl,7,2) AS to_date, count(*) AS n_assets,
 round(sum(retained)/sum(n_from),6) AS retention_pooled, round(quantile_cont(retention_rate,0.5),6) AS retention_median, round(sum(new)/sum(n_to),6) AS new_rate_pooled, CAST(sum(retained) AS BIGINT) AS retained, CAST(sum(new) AS BIGINT) AS new, CAST(sum(lost) AS BIGINT) AS lost
 FROM ch GROUP BY from_crawl, to_crawl)"""


@query("churn_by_asset", f"WITH {CHURN} SELECT from_crawl, to_crawl, asset_id, song_id, n_from, n_to, retained, new, lost, round(retention_rate,6) AS retention_rate, round(new_rate,6) AS new_rate FROM ch")
def _(t):
    return lo.churn(*a.crawl_rows(t.events))


@query("churn_intervals", f"WITH {CHURN}, {INTERVALS} SELECT * FROM iv")
def _(t):
    return lo.churn_intervals(lo.churn(*a.crawl_rows(t.events)))


@query("churn_headline", f"WITH {CHURN}, {INTERVALS} SELECT * FROM iv ORDER BY to_date DESC LIMIT 1")
def _(t):
    return lo.churn_headline(lo.churn_intervals(lo.churn(*a.crawl_rows(t.events))))


@query("snapshot_status", f"""WITH {CRAWLS} SELECT r.crawl_id, strftime(started_at,'%Y-%m-%d %H:%M:%S') AS started_at, mode, status, count(DISTINCT reel_pk) AS n_reels, count(*) AS n_seen_rows, count(DISTINCT asset_id) AS n_assets, count(DISTINCT song_id) AS n_songs
 FROM runs r JOIN seen s USING (crawl_id) GROUP BY ALL""")
def _(t):
    return lo.snapshot_status(*a.crawl_rows(t.events))


@query("snapshot_rows", f"""WITH {REELS} SELECT 'now' AS crawl_id, reel_pk, asset_id, song_id, '2024-02-01 00:00:00' AS seen_at, row_number() OVER (ORDER BY reel_pk) AS rank_pos, play_count, like_count, comment_count FROM reels""")
def _(t):
    return lo.snapshot(a.reels(t.orders), "now", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("seen_upsert", f"""WITH {CRAWLS}, nw AS (SELECT crawl_id, reel_pk, asset_id, play_count+100 AS play_count FROM seen WHERE asset_id='click' UNION ALL SELECT 'new', reel_pk, asset_id, play_count FROM seen WHERE asset_id='view' AND crawl_id='20240101T000000Z')
SELECT crawl_id, reel_pk, asset_id, play_count FROM seen WHERE asset_id<>'click' UNION ALL SELECT * FROM nw""")
def _(t):
    _runs, seen = a.crawl_rows(t.events)
    seen = seen.select("crawl_id", "reel_pk", "asset_id", "play_count")
    new = seen.filter("asset_id = 'click'").withColumn("play_count", F.col("play_count") + 100).unionByName(
        seen.filter("asset_id = 'view' AND crawl_id = '20240101T000000Z'").withColumn("crawl_id", F.lit("new"))
    )
    return lo.upsert(seen, new)


# samples ---------------------------------------------------------------------

SAMPLE = """m AS (SELECT song_id AS s, quantile_cont(impact_metric,0.5) AS mid, count(*) AS n FROM {src} GROUP BY 1),
r AS (SELECT x.*, row_number() OVER (PARTITION BY song_id ORDER BY impact_metric DESC, reel_pk) AS rt, row_number() OVER (PARTITION BY song_id ORDER BY abs(impact_metric-mid), reel_pk) AS rm, n FROM {src} x JOIN m ON s=song_id),
p1 AS (SELECT *, CASE WHEN rt<={a} THEN 'top_impact' WHEN n>2 AND rm<={b} THEN 'median_impact' END AS why FROM r),
p2 AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY song_id, why IS NULL ORDER BY md5('42:'||reel_pk)) END AS rr FROM p1),
bysong AS (SELECT reel_pk, song_id, coalesce(why, 'random') AS sample_reason FROM p2 WHERE why IS NOT NULL OR rr<={c})"""


@query("sample_by_song", f"WITH {REELS}, {SAMPLE.format(src='reels', a=3, b=2, c=3)} SELECT * FROM bysong")
def _(t):
    return lo.sample_by_song(a.reels(t.orders)).select("reel_pk", "song_id", "sample_reason")


CONTEXT = """ctx AS (SELECT reel_pk, song_id, impact_metric, unnest(list_distinct(context_categories)) AS c FROM cl), ct AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY impact_metric DESC, reel_pk) AS r FROM ctx WHERE c IN ('city','nature','home')),
bycontext AS (SELECT reel_pk, song_id, 'context:'||(list(c ORDER BY list_position(['city','nature','home'], c)))[1] AS sample_reason FROM ct WHERE r<={n} GROUP BY 1,2)"""


@query("sample_by_context", f"WITH {CL}, {CONTEXT.format(n=5)} SELECT * FROM bycontext")
def _(t):
    return lo.sample_by_context(classified(t), CTX).select("reel_pk", "song_id", "sample_reason")


@query("close_reading_sample", f"WITH {CL}, {SAMPLE.format(src='cl', a=2, b=1, c=1)}, {CONTEXT.format(n=3)} SELECT * FROM bysong UNION ALL SELECT * FROM bycontext WHERE reel_pk NOT IN (SELECT reel_pk FROM bysong)")
def _(t):
    return lo.close_reading_sample(classified(t), CTX).select("reel_pk", "song_id", "sample_reason")


SLOTS = [
    {"slot": "one", "song": "src1", "contexts": ["city"], "mode": "top", "n": 3},
    {"slot": "two", "contexts": ["nature"], "keywords": ["license"], "mode": "median", "n": 2},
    {"slot": "three", "mode": "random_visual_no_music", "n": 4},
    {"slot": "four", "song": "src2", "keywords": ["no such keyword"], "mode": "random", "n": 2},
]


@query("curated_sample", f"""WITH {CL}, s1 AS (SELECT reel_pk FROM cl WHERE song_id='src1' AND list_contains(context_categories,'city') ORDER BY impact_metric DESC, reel_pk LIMIT 3),
b2 AS (SELECT * FROM cl WHERE list_contains(context_categories,'nature') AND contains(lower(caption_text),'license') AND reel_pk NOT IN (FROM s1)), s2 AS (SELECT reel_pk FROM b2 ORDER BY abs(impact_metric-(SELECT quantile_cont(impact_metric,0.5) FROM b2)), reel_pk LIMIT 2),
s3 AS (SELECT reel_pk FROM cl WHERE list_has_any(context_categories,['home','nature']) AND NOT contains(lower(caption_text),'tion') AND reel_pk NOT IN (FROM s1 UNION ALL FROM s2) ORDER BY md5('42:'||reel_pk) LIMIT 4),
s4 AS (SELECT reel_pk FROM cl WHERE song_id='src2' AND reel_pk NOT IN (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3) ORDER BY md5('42:'||reel_pk) LIMIT 2)
SELECT reel_pk, 'curated:one' AS sample_reason FROM s1 UNION ALL SELECT reel_pk, 'curated:two' FROM s2 UNION ALL SELECT reel_pk, 'curated:three' FROM s3 UNION ALL SELECT reel_pk, 'curated:four' FROM s4""")
def _(t):
    return lo.curated_sample(classified(t), SLOTS, ["tion"], ["home", "nature"], tags=None).select("reel_pk", "sample_reason")


@query("validation_sample", f"""WITH {CL}, e AS (SELECT reel_pk, unnest(list_distinct(context_categories)) AS validation_category FROM cl) SELECT reel_pk, validation_category, 'context' AS validation_dimension FROM
 (SELECT *, row_number() OVER (PARTITION BY validation_category ORDER BY md5('42:'||reel_pk)) AS r FROM e WHERE validation_category<>'context_unknown') WHERE r<=5""")
def _(t):
    return lo.validation_sample(classified(t), "context", "context_unknown").select("reel_pk", "validation_category", "validation_dimension")


@query("annotation_sample", f"""WITH {ANNOTATIONS} SELECT reel_pk, dimension, category, source, round(confidence,6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY dimension, category ORDER BY md5('42:'||reel_pk)) AS r
 FROM annotations WHERE source='vision' AND confidence>=0.4) WHERE r<=10""")
def _(t):
    return lo.annotation_sample(a.annotations(t.labels), min_confidence=0.4)


@query("verdict_precision", """WITH v AS (SELECT lang AS dimension, source AS category, quality::DOUBLE AS verdict FROM labels JOIN documents USING (doc_id)), g AS (SELECT dimension, category, count(*) AS checked, sum(verdict) AS correct FROM v GROUP BY 1,2)
SELECT *, round(correct/checked,2) AS precision, round((SELECT avg(verdict) FROM v),2) AS overall_precision, round(correct/checked,2)<0.7 AS weak FROM g""")
def _(t):
    v = t.labels.join(t.documents, "doc_id").select(F.col("lang").alias("dimension"), F.col("source").alias("category"), F.col("quality").cast("double").alias("verdict"))
    return lo.verdict_precision(v)


@query("unknown_hashtags", f"""WITH {CL}, tg AS (SELECT reel_pk, unnest(list_distinct(regexp_extract_all(lower(caption_text), '(\\w+ing)\\b', 1))) AS hashtag FROM cl WHERE format_categories=['format_unknown'])
SELECT hashtag, count(*) AS count FROM tg GROUP BY 1 ORDER BY count DESC, hashtag LIMIT 40""")
def _(t):
    tags = t.documents.select(F.col("doc_id").alias("reel_pk"), F.explode(F.array_distinct(talk.tx.find_all(F.lower("text"), r"(\w+ing)\b", 1))).alias("hashtag"))
    return lo.unknown_hashtags(classified(t), tags, "format", "format_unknown")


@query("multicategory_reels", f"WITH {CL} SELECT reel_pk, len(list_distinct(context_categories)) AS n_categories, array_to_string(context_categories, ', ') AS categories FROM cl WHERE len(list_distinct(context_categories))>=2 ORDER BY n_categories DESC, reel_pk LIMIT 100")
def _(t):
    return lo.multicategory_reels(classified(t), "context", 2).select("reel_pk", "n_categories", "categories")


# agreement -------------------------------------------------------------------

CONC = f"""{CL}, cv2 AS (SELECT reel_pk, dimension, category, max(confidence) AS w FROM annotations WHERE source='vision' GROUP BY 1,2,3),
kv AS (SELECT reel_pk, 'context' AS dimension, ck AS k FROM cl UNION ALL SELECT reel_pk, 'format', fk FROM cl UNION ALL SELECT reel_pk, 'aesthetic', ak FROM cl),
ke AS (SELECT reel_pk, dimension, unnest(k) AS kc FROM kv),
sim AS (SELECT 'context' AS dimension, unnest(['city','home','nature','home']) AS a, unnest(['home','city','home','nature']) AS b, unnest([0.5,0.5,0.25,0.25]) AS s),
kvp AS (SELECT ke.reel_pk, ke.dimension, kc, category AS vc, w, CASE WHEN kc=category THEN 1.0 ELSE coalesce(s,0) END AS s FROM ke JOIN cv2 USING (reel_pk, dimension) LEFT JOIN sim ON sim.dimension=ke.dimension AND a=kc AND b=category),
ki AS (SELECT reel_pk, dimension, sum(m) AS x FROM (SELECT reel_pk, dimension, kc, max(s*w) AS m FROM kvp GROUP BY 1,2,3) GROUP BY 1,2),
vi AS (SELECT reel_pk, dimension, sum(m) AS x FROM (SELECT reel_pk, dimension, vc, max(s)*min(w) AS m FROM kvp GROUP BY 1,2,3) GROUP BY 1,2),
vt AS (SELECT reel_pk, dimension, sum(w) AS t, count(*) AS n, list(category ORDER BY category) AS v FROM cv2 GROUP BY 1,2),
cr0 AS (SELECT kv.*, coalesce(v,[]) AS v, (coalesce(ki.x,0)+coalesce(vi.x,0))*0.5 AS inter, len(k)+coalesce(t,0) AS tot FROM kv LEFT JOIN vt USING (reel_pk, dimension) LEFT JOIN ki USING (reel_pk, dimension) LEFT JOIN vi USING (reel_pk, dimension)),
cr AS (SELECT *, CASE WHEN len(k)=0 AND len(v)=0 THEN NULL WHEN tot-inter>0 THEN inter/(tot-inter) ELSE 0 END AS score FROM cr0)"""


def concordance(t):
    return lo.concordance_rows(classified(t), a.annotations(t.labels), RULES, ADJACENCY)


@query("confidence_scan", f"WITH {ANNOTATIONS} SELECT reel_pk, dimension, category, round(max(confidence),6) AS confidence FROM annotations WHERE source='vision' GROUP BY 1,2,3")
def _(t):
    return lo.confidence_scan(a.annotations(t.labels))


@query("concordance_scores", f"WITH {CONC} SELECT reel_pk, dimension, round(score,6) AS score FROM cr")
def _(t):
    return concordance(t).select("reel_pk", "dimension", "score")


@query("concordance_by_dimension", f"""WITH {CONC} SELECT dimension, count(score) AS comparable_reels, round(coalesce(avg(score),0),4) AS mean_concordance, round(coalesce(quantile_cont(score,0.5),0),4) AS median_concordance,
 round(coalesce(count(*) FILTER (score>=0.999)/nullif(count(score),0),0),4) AS exact_agreement_share, round(coalesce(count(*) FILTER (score<=1e-9)/nullif(count(score),0),0),4) AS zero_agreement_share,
 count(*) FILTER (len(k)>0 AND len(v)=0) AS keyword_only_unknown, count(*) FILTER (len(k)=0 AND len(v)>0) AS vision_only_unknown, count(*) FILTER (len(k)=0 AND len(v)=0) AS both_unknown FROM cr GROUP BY 1""")
def _(t):
    return lo.concordance_by_dimension(concordance(t))


@query("concordance_confusion", f"""WITH {CONC}, e AS (SELECT dimension, unnest(CASE WHEN len(k)>0 THEN k ELSE [dimension||'_unknown'] END) AS keyword_category, v FROM cr)
SELECT dimension, keyword_category, vision_category, count(*) AS n_reels FROM (SELECT dimension, keyword_category, unnest(CASE WHEN len(v)>0 THEN v ELSE [dimension||'_unknown'] END) AS vision_category FROM e) GROUP BY 1,2,3""")
def _(t):
    return lo.concordance_confusion(concordance(t), RULES)


@query("concordance_disagreements", f"""WITH {CONC}, e AS (SELECT dimension, k, v, unnest(list_distinct(list_concat(k,v))) AS category FROM cr), g AS (SELECT dimension, category, count(*) FILTER (list_contains(k,category) AND list_contains(v,category)) AS "both",
 count(*) FILTER (NOT list_contains(v,category)) AS keyword_only, count(*) FILTER (NOT list_contains(k,category)) AS vision_only FROM e GROUP BY 1,2)
SELECT *, keyword_only+vision_only AS divergence, round("both"/("both"+keyword_only+vision_only),4) AS agreement_rate FROM g""")
def _(t):
    return lo.concordance_disagreements(concordance(t))


@query("tag_averages", f"WITH {ANNOTATIONS} SELECT dimension, category, count(*) AS n, round(avg(confidence),3) AS avg_confidence FROM annotations WHERE source='vision' GROUP BY 1,2")
def _(t):
    return lo.tag_averages(a.annotations(t.labels))


@query("mapped_model_output", f"""WITH x AS (SELECT doc_id AS reel_pk, ['nature','nonsense','home','nature'] AS c, [quality*1.5, 1.0, toxic-0.5, 0.3] AS w FROM labels), e AS (SELECT reel_pk, unnest(c) AS category, unnest(w) AS confidence, unnest([1,2,3,4]) AS i FROM x)
SELECT reel_pk, 'context' AS dimension, category, round(greatest(0,least(1,arg_min(confidence, i))),6)::DOUBLE AS confidence FROM e WHERE category<>'nonsense' GROUP BY 1,3""")
def _(t):
    item = "named_struct('category', '{}', 'confidence', {})"
    raw = f"to_json(named_struct('context', array({item.format('nature', 'quality * 1.5D')}, {item.format('nonsense', '1.0D')}, {item.format('home', 'toxic - 0.5D')}, {item.format('nature', '0.3D')})))"
    return lo.map_model_output(t.labels.select(F.col("doc_id").alias("reel_pk"), F.expr(raw).alias("output")), RULES)
