"""Queries for audio and edit features."""

from pyspark.sql import functions as F

from ..operators import media, scope
from ..sources import adapters as a
from .registry import query
from .views import ACOUSTICS, ALIGNMENTS, EDITS, REELS, fold_sql

KEYS_SQL = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"


@query("impact_by_asset_median", f"WITH {REELS} SELECT asset_id, count(*) AS n_reels, quantile_cont(impact_metric,0.5) AS median_impact FROM reels GROUP BY 1")
def _(t):
    return media.impact_by_asset(a.reels(t.orders))


FOLD = "(({0})/pow(2.0, floor(log2({0})+0.5)))"


def dist(x, y):
    f = FOLD.format(f"({x}/{y})")
    return f"greatest({f}, 1/{f})"


@query("variant_pairs", f"""WITH {ACOUSTICS}, p AS (SELECT x.song_id, x.asset_id AS asset_a, y.asset_id AS asset_b, x.tempo AS tempo_a, y.tempo AS tempo_b, {dist('x.tempo', 'y.tempo')} AS r, (y.pc-x.pc+12)%12 AS d,
 abs(x.spectral_centroid-y.spectral_centroid) AS dc, abs(x.spectral_flatness-y.spectral_flatness) AS df, abs(x.loudness_lufs-y.loudness_lufs) AS dl FROM acoustics x JOIN acoustics y ON x.song_id=y.song_id AND x.asset_id<y.asset_id)
SELECT song_id, asset_a, asset_b, tempo_a, tempo_b, round(r,6) AS tempo_ratio, abs(CASE WHEN d>6 THEN d-12 ELSE d END)::BIGINT AS key_shift_semitones, round(dc,6) AS abs_delta_centroid, round(df,6) AS abs_delta_flatness, round(dl,6) AS abs_delta_loudness FROM p WHERE r<=1.1""")
def _(t):
    return media.variant_pairs(a.acoustics(t.embeddings), 0.1)


@query("variant_pairs_all", f"""WITH {ACOUSTICS}, p AS (SELECT x.song_id, x.asset_id AS asset_a, y.asset_id AS asset_b, x.q AS label_a, y.q AS label_b, x.tempo AS tempo_a, y.tempo AS tempo_b, {dist('x.tempo', 'y.tempo')} AS r, (y.pc-x.pc+12)%12 AS d,
 abs(x.spectral_centroid-y.spectral_centroid) AS dc, abs(x.spectral_flatness-y.spectral_flatness) AS df, abs(x.loudness_lufs-y.loudness_lufs) AS dl FROM acoustics x JOIN acoustics y ON x.song_id=y.song_id AND x.asset_id<y.asset_id)
SELECT song_id, asset_a, asset_b, label_a, label_b, tempo_a, tempo_b, round(r,6) AS tempo_ratio, abs(CASE WHEN d>6 THEN d-12 ELSE d END)::BIGINT AS key_shift_semitones, round(dc,6) AS abs_delta_centroid, round(df,6) AS abs_delta_flatness, round(dl,6) AS abs_delta_loudness FROM p""")
def _(t):
    return media.variant_pairs(a.acoustics(t.embeddings).withColumn("variant_label", F.substring_index("est_key", " ", -1)))


@query("variant_dispersion", f"""WITH {ACOUSTICS}, g AS (SELECT song_id, count(DISTINCT asset_id) AS n_variants, min(tempo) AS tempo_min, max(tempo) AS tempo_max, count(DISTINCT est_key) AS n_distinct_keys, min(spectral_centroid) AS centroid_min, max(spectral_centroid) AS centroid_max,
 min(loudness_lufs) AS loudness_min, max(loudness_lufs) AS loudness_max FROM acoustics GROUP BY 1 HAVING count(DISTINCT asset_id)>=2)
SELECT *, round({dist('tempo_max', 'tempo_min')},6) AS tempo_spread_ratio, round(centroid_max-centroid_min,6) AS centroid_range, round(loudness_max-loudness_min,6) AS loudness_range FROM g""")
def _(t):
    return media.variant_dispersion(a.acoustics(t.embeddings))


@query("variant_reach", f"""WITH {REELS}, i AS (SELECT asset_id, min(song_id) AS song_id, count(*) AS n_reels, quantile_cont(impact_metric,0.5) AS median_impact FROM reels GROUP BY 1), m AS (SELECT song_id, quantile_cont(median_impact,0.5) AS mid FROM i GROUP BY 1)
SELECT song_id, asset_id, n_reels, median_impact, row_number() OVER (PARTITION BY song_id ORDER BY median_impact DESC, asset_id) AS reach_rank, round(median_impact/mid,6) AS ratio_to_song_median FROM i JOIN m USING (song_id)""")
def _(t):
    r = a.reels(t.orders)
    return media.variant_reach(r.select("song_id", "asset_id").distinct(), media.impact_by_asset(r))


IDENTITY = f"""{ACOUSTICS}, np AS (SELECT x.asset_id AS s, y.asset_id AS d FROM acoustics x JOIN acoustics y ON x.song_id=y.song_id AND x.asset_id<y.asset_id
 WHERE {dist('x.tempo', 'y.tempo')}<=1.02 AND x.pc=y.pc AND abs(x.spectral_centroid-y.spectral_centroid)/greatest(x.spectral_centroid,y.spectral_centroid)<=0.05),
reach AS (WITH RECURSIVE sym AS (SELECT s, d FROM np UNION SELECT d, s FROM np), walk(node, seen) AS (SELECT s, s FROM sym UNION SELECT d, seen FROM walk JOIN sym ON s=node) SELECT node, min(seen) AS rep FROM walk GROUP BY 1),
ident AS (SELECT song_id, asset_id, coalesce(rep, asset_id) AS rep FROM acoustics LEFT JOIN reach ON node=asset_id)"""


@query("variant_identity", f"""WITH {IDENTITY} SELECT song_id, asset_id, song_id||'#'||(dense_rank() OVER (PARTITION BY song_id ORDER BY rep)-1) AS identity_group, count(*) OVER (PARTITION BY song_id, rep) AS group_size, asset_id=rep AS is_representative FROM ident""")
def _(t):
    return media.variant_identity(a.acoustics(t.embeddings))


@query("collapsed_variants", f"WITH {IDENTITY} SELECT song_id, asset_id FROM ident WHERE asset_id=rep")
def _(t):
    f = a.acoustics(t.embeddings)
    return media.collapse_variants(f, media.variant_identity(f)).select("song_id", "asset_id")


def clips(t):
    return a.acoustics(t.embeddings).select(
        F.col("song_id").alias("asset_id"), F.col("asset_id").alias("clip_id"), "tempo", "spectral_centroid", "est_key",
        F.concat(F.split_part("est_key", F.lit(" "), F.lit(1)), F.lit(" Minor")).alias("est_key_alt"), F.col("tempo").alias("duration"), F.array(F.col("tempo") / 4, F.col("tempo") / 2).alias("segment_boundaries"),
    ).join(t.embeddings.select(F.format_string("a%06d", "vec_id").alias("clip_id"), F.array(*a.folded(F.col("embedding"), 4)).alias("mfcc_mean")), "clip_id")


@query("feature_consensus", f"""WITH {ACOUSTICS}, c AS (SELECT *, list_extract(string_split(est_key,' '),1)||' Minor' AS alt FROM acoustics), g AS (SELECT song_id AS asset_id, count(*) AS n_clips, quantile_cont(tempo,0.5) AS tempo, quantile_cont(spectral_centroid,0.5) AS spectral_centroid, max(tempo) AS mx FROM c GROUP BY 1),
k AS (SELECT DISTINCT ON (song_id) song_id AS asset_id, est_key FROM (SELECT song_id, est_key, count(*) AS n, min(asset_id) AS f FROM c GROUP BY 1,2) ORDER BY song_id, n DESC, f),
k2 AS (SELECT DISTINCT ON (song_id) song_id AS asset_id, alt AS est_key_alt FROM (SELECT song_id, alt, count(*) AS n, min(asset_id) AS f FROM c GROUP BY 1,2) ORDER BY song_id, n DESC, f),
mv AS (SELECT 's'||label AS asset_id, i, round(quantile_cont(e[i],0.5),4) AS m FROM (SELECT label, [{', '.join(fold_sql(4, b) for b in range(4))}] AS e FROM embeddings), range(1,5) r(i) GROUP BY 1,2), mf AS (SELECT asset_id, max(m) FILTER (i=1) AS m1, max(m) FILTER (i=2) AS m2, max(m) FILTER (i=3) AS m3, max(m) FILTER (i=4) AS m4 FROM mv GROUP BY 1)
SELECT asset_id, n_clips, round(tempo,6) AS tempo, round(spectral_centroid,6) AS spectral_centroid, est_key, est_key_alt, m1, m2, m3, m4, CASE WHEN est_key=est_key_alt THEN 1.0 WHEN list_extract(string_split(est_key,' '),1)=list_extract(string_split(est_key_alt,' '),1) THEN 0.5
 WHEN list_extract(string_split(est_key,' '),2)='Major' AND (list_position({KEYS_SQL},list_extract(string_split(est_key,' '),1))+8)%12+1=list_position({KEYS_SQL},list_extract(string_split(est_key_alt,' '),1)) THEN 0.5 ELSE 0.0 END::DOUBLE AS key_agreement
FROM g JOIN k USING (asset_id) JOIN k2 USING (asset_id) JOIN mf USING (asset_id)""")
def _(t):
    return media.feature_consensus(clips(t), ["tempo", "spectral_centroid"], ["mfcc_mean"]).select("*", *[F.col("mfcc_mean")[i].alias(f"m{i + 1}") for i in range(4)]).drop("segment_boundaries", "mfcc_mean")


def _profiles() -> str:
    import numpy as np

    rows = []
    for q, (name, p) in enumerate((("Major", media.MAJOR), ("Minor", media.MINOR))):
        c = np.array(p) - np.mean(p)
        for k in range(12):
            rows.append(f"({12 * q + k}, '{media.KEY_NAMES[k]} {name}', {np.roll(c, k).tolist()}, {float(np.linalg.norm(c))!r})")
    return f"(VALUES {', '.join(rows)}) AS pr(o, key, p, pn)"


@query("chroma_keys", f"""WITH x0 AS (SELECT vec_id, [{', '.join(fold_sql(12, b, element='abs(x::DOUBLE)') for b in range(12))}] AS c FROM embeddings), x AS (SELECT vec_id, list_transform(c, lambda v: v-list_avg(c)) AS x FROM x0),
s AS (SELECT vec_id, key, o, list_dot_product(x, p)/(sqrt(list_dot_product(x,x))*pn+1e-10) AS r FROM x, {_profiles()}), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, o) AS n FROM s)
SELECT vec_id, max(key) FILTER (n=1) AS key, round(greatest(0,least(1,max(r) FILTER (n=1)-max(r) FILTER (n=2))),6) AS confidence FROM k GROUP BY 1""")
def _(t):
    chroma = F.array(*a.folded(F.transform("embedding", lambda v: F.abs(v.cast("double"))), 12))
    return t.embeddings.select("vec_id", media.chroma_key(chroma).alias("k")).select("vec_id", "k.key", "k.confidence")


@query("overlay_counts", f"WITH {ALIGNMENTS}, o AS (SELECT CASE WHEN align_confidence IS NULL THEN has_overlay WHEN align_confidence<0.3 THEN 1 ELSE 0 END AS h FROM aligned) SELECT CASE WHEN h=1 THEN 'overlay' ELSE 'clean' END AS kind, count(*) AS n FROM o GROUP BY 1")
def _(t):
    return media.overlay_counts(media.apply_overlay_threshold(a.alignments(t.events), 0.3))


def timeline(t):
    """Track lengths: every third asset has a measured length, the others use acoustic or span ends."""
    used = a.alignments(t.events)
    assets = used.select("asset_id").distinct().withColumn("n", F.regexp_extract("asset_id", r"(\d+)", 1).cast("int"))
    acoustics = assets.select("asset_id", F.when(F.col("n") % 2 == 0, F.lit(180.0)).alias("duration"), F.array(F.lit(30.0), F.lit(60.0), F.lit(120.0)).alias("segment_boundaries"))
    music = assets.select("asset_id", F.when(F.col("n") % 3 == 0, F.lit(150.0)).alias("duration_real_s"))
    return used, media.asset_timeline(used, acoustics, music)


TL = rf"""{ALIGNMENTS}, tl0 AS (SELECT asset_id, CAST(regexp_extract(asset_id,'\d+') AS INTEGER) AS n, max(used_segment_end) FILTER (used_segment_start IS NOT NULL) AS last FROM aligned GROUP BY 1),
tl AS (SELECT asset_id, CASE WHEN n%3=0 THEN 150.0 WHEN n%2=0 THEN 180.0 ELSE last END::DOUBLE AS length, CASE WHEN n%3=0 OR n%2=0 THEN [30.0,60.0,120.0] ELSE [] END AS b FROM tl0)"""


@query("asset_timeline", f"WITH {TL} SELECT asset_id, length FROM tl")
def _(t):
    return timeline(t)[1].select("asset_id", "length")


@query("segment_usage", f"""WITH {TL}, e AS (SELECT asset_id, length, list_concat([0.0], b, [length]) AS e FROM tl), g AS (SELECT asset_id, e, unnest(range(0, len(e)-1)) AS segment, length FROM e),
m AS (SELECT asset_id, (used_segment_start+used_segment_end)/2 AS mid FROM aligned WHERE used_segment_start IS NOT NULL),
p AS (SELECT asset_id, least(len(list_filter(e, lambda x: x<=mid))-1, len(e)-2) AS segment, count(*) AS reels FROM m JOIN e USING (asset_id) GROUP BY 1,2)
SELECT asset_id, segment, e[segment+1]::DOUBLE AS start, e[segment+2]::DOUBLE AS end, coalesce(reels,0) AS reels FROM g LEFT JOIN p USING (asset_id, segment)""")
def _(t):
    used, line = timeline(t)
    return media.segment_usage(used, line)


@query("coverage_heat", f"""WITH {TL}, s AS (SELECT asset_id, floor(greatest(0,used_segment_start)/(length/120)) AS lo, least(120, ceil(least(length,used_segment_end)/(length/120))) AS hi FROM aligned JOIN tl USING (asset_id) WHERE used_segment_start IS NOT NULL),
g AS (SELECT DISTINCT asset_id, bin FROM s, range(0,120) r(bin))
SELECT asset_id, bin, count(s.lo) AS coverage FROM g LEFT JOIN s USING (asset_id) WHERE true GROUP BY 1,2 HAVING false
UNION ALL SELECT g.asset_id, g.bin, (SELECT count(*) FROM s WHERE s.asset_id=g.asset_id AND s.lo<=g.bin AND g.bin<s.hi) FROM g""")
def _(t):
    used, line = timeline(t)
    return media.coverage_heat(used, line)


@query("overlay_threshold", f"""WITH {ALIGNMENTS}, h AS (SELECT b, (SELECT count(*) FROM aligned WHERE align_confidence>=0 AND align_confidence<=1 AND least(floor(align_confidence*20),19)=b) AS c FROM range(0,20) r(b)),
lo AS (SELECT b FROM h WHERE b<10 ORDER BY c DESC, b LIMIT 1), hi AS (SELECT b FROM h WHERE b>=10 ORDER BY c DESC, b LIMIT 1)
SELECT round((b+0.5)/20,2) AS threshold FROM h WHERE b BETWEEN (SELECT b FROM lo) AND (SELECT b FROM hi) ORDER BY c, b LIMIT 1""")
def _(t):
    return media.suggest_threshold(a.alignments(t.events))


@query("confidence_calibration", f"WITH {ALIGNMENTS} SELECT reel_pk, asset_id, round(align_confidence,6) AS align_confidence, used_segment_start, used_segment_end, has_overlay FROM aligned WHERE align_confidence IS NOT NULL")
def _(t):
    return media.confidence_calibration(a.alignments(t.events))


@query("acoustic_sample", f"""WITH {ACOUSTICS}, s AS (SELECT printf('a%06d', doc_id%500) AS asset_id, min(doc_id) AS sample_reel_pk FROM documents GROUP BY 1)
SELECT asset_id, sample_reel_pk, least(abs(loudness_lufs), spectral_flatness) AS min_confidence FROM acoustics LEFT JOIN s USING (asset_id) ORDER BY (q='Major')::INT, spectral_flatness, min_confidence, asset_id LIMIT 50""")
def _(t):
    rows = a.acoustics(t.embeddings).select(
        "asset_id", F.when(F.col("est_key").endswith("Major"), "canonical").otherwise("reel").alias("audio_source"), F.col("spectral_flatness").alias("key_agreement"),
        F.abs("loudness_lufs").alias("tempo_confidence"), F.col("spectral_flatness").alias("est_key_confidence"),
    )
    reels = t.documents.select(F.col("doc_id").alias("reel_pk"), F.format_string("a%06d", F.col("doc_id") % 500).alias("asset_id"))
    return media.acoustic_sample(rows, reels, 50).select("asset_id", "sample_reel_pk", "min_confidence")


@query("aligned_cuts", f"WITH {EDITS} SELECT reel_pk, array_to_string(list_transform(cut_times, lambda c: round(c+floor(duration),4)),'|') AS cuts FROM edits")
def _(t):
    return a.edits(t.lineitem, t.orders).select("reel_pk", media.align_cuts("cut_times", F.floor("duration")).alias("cuts"))


def samples(t):
    """Signal samples per user: hours since the start of the year and the value as difference."""
    return t.events.select(F.col("user_id").alias("reel_pk"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000).alias("t"), (F.col("value") / 400).alias("diff"))


@query("soft_transitions", """WITH s AS (SELECT user_id AS reel_pk, (epoch_us(ts)-1704067200000000)/3600000000 AS t, value/400 AS d FROM events), i AS (SELECT *, count(*) FILTER (d<0.15) OVER (PARTITION BY reel_pk ORDER BY t) AS isl FROM s),
r AS (SELECT reel_pk, min(t) AS a, max(t) AS z FROM i WHERE d>=0.15 GROUP BY reel_pk, isl HAVING count(*)>=2 AND max(t)-min(t)>=0.4),
c AS (SELECT o_custkey AS reel_pk, list(o_totalprice/1000) AS cuts FROM orders GROUP BY 1)
SELECT reel_pk, round((a+z)/2,4) AS soft_time FROM r LEFT JOIN c USING (reel_pk) WHERE NOT coalesce(len(list_filter(cuts, lambda x: abs((a+z)/2-x)<=0.5))>0, false)""")
def _(t):
    cuts = t.orders.groupBy(F.col("o_custkey").alias("reel_pk")).agg(F.collect_list(F.col("o_totalprice") / 1000).alias("cut_times"))
    return media.soft_transitions(samples(t), cuts)


CHAMFER = "(list_avg(list_transform({a}, lambda u: list_min(list_transform({b}, lambda v: abs(v-u)))))+list_avg(list_transform({b}, lambda u: list_min(list_transform({a}, lambda v: abs(v-u))))))/2"
DB = f"""{EDITS}, ok AS (SELECT reel_pk, asset_id, cut_times AS c FROM edits WHERE o_orderstatus<>'P' AND len(cut_times)>0),
nb AS (SELECT x.reel_pk AS s, y.reel_pk AS d, x.asset_id FROM ok x JOIN ok y ON x.asset_id=y.asset_id AND x.reel_pk<y.reel_pk WHERE {CHAMFER.format(a='x.c', b='y.c')}<=0.5),
reach AS (WITH RECURSIVE sym AS (SELECT s, d FROM nb UNION SELECT d, s FROM nb), walk(node, seen) AS (SELECT s, s FROM sym UNION SELECT d, seen FROM walk JOIN sym ON s=node) SELECT node, min(seen) AS home FROM walk GROUP BY 1),
lab AS (SELECT asset_id, home, row_number() OVER (PARTITION BY asset_id ORDER BY home)-1 AS label FROM (SELECT DISTINCT asset_id, home FROM reach JOIN ok ON node=reel_pk)),
cl AS (SELECT reel_pk, asset_id, coalesce(label,-1) AS edit_cluster FROM ok LEFT JOIN reach ON node=reel_pk LEFT JOIN lab USING (asset_id, home) UNION ALL SELECT reel_pk, asset_id, NULL FROM edits WHERE reel_pk NOT IN (SELECT reel_pk FROM ok))"""


def clusters(t):
    e = a.edits(t.lineitem, t.orders)
    aligned = e.select("reel_pk", F.when(F.col("o_orderstatus") != "P", F.lit(0.0)).alias("used_segment_start"), F.lit(0).alias("has_overlay"))
    return media.cluster_edits(e, aligned), e


@query("edit_clusters", f"WITH {DB} SELECT reel_pk, asset_id, edit_cluster FROM cl")
def _(t):
    return clusters(t)[0]


@query("edit_grouping_totals", f"""WITH {DB}, g AS (SELECT asset_id, count(*) AS n_reels, count(DISTINCT edit_cluster) FILTER (edit_cluster>=0) AS n_groups, count(*) FILTER (edit_cluster>=0) AS n_grouped_reels FROM cl GROUP BY 1)
SELECT * FROM g UNION ALL SELECT NULL, CAST(sum(n_reels) AS BIGINT), CAST(sum(n_groups) AS BIGINT), CAST(sum(n_grouped_reels) AS BIGINT) FROM g""")
def _(t):
    return media.grouping_totals(clusters(t)[0])


@query("consensus_cuts", f"""WITH {DB}, m AS (SELECT cl.asset_id, edit_cluster, reel_pk, cut_times FROM cl JOIN edits USING (reel_pk) WHERE edit_cluster>=0), n AS (SELECT asset_id, edit_cluster, count(*) AS n FROM m GROUP BY 1,2),
e AS (SELECT asset_id, edit_cluster, unnest(cut_times) AS x FROM m), g AS (SELECT asset_id, edit_cluster, CAST(round_even(x/0.5,0) AS BIGINT) AS slot, count(*) AS hits, quantile_cont(x,0.5) AS cut_time FROM e GROUP BY 1,2,3)
SELECT asset_id, edit_cluster, slot, hits, cut_time FROM g JOIN n USING (asset_id, edit_cluster) WHERE hits>=greatest(2,(n+1)//2)""")
def _(t):
    return media.consensus_cuts(*clusters(t))


@query("edit_group_table", f"""WITH {DB} SELECT cl.asset_id, edit_cluster, count(*) AS members, quantile_cont(len(cut_times),0.5) AS median_cuts, quantile_cont(len(soft_times),0.5) AS median_soft, round(quantile_cont(duration,0.5),6) AS median_duration
 FROM cl JOIN edits USING (reel_pk) WHERE edit_cluster>=0 GROUP BY 1,2""")
def _(t):
    return media.group_table(*clusters(t))


@query("assets_by_song", f"WITH {REELS}, n AS (SELECT song_id, asset_id, count(*) AS n_reels FROM reels GROUP BY 1,2) SELECT *, CAST(sum(n_reels) OVER (PARTITION BY song_id) AS BIGINT) AS song_reels FROM n")
def _(t):
    r = a.reels(t.orders)
    return media.assets_by_song(r.select("song_id", "asset_id").distinct(), r)


def payload(df, expr: str):
    return df.select(F.concat(F.lit("p"), "p_partkey").alias("asset_id"), F.expr(f"to_json({expr})").alias("payload"))


@query("external_links", """SELECT 'p'||p_partkey AS asset_id, 'deezer' AS platform, 'http://d/'||p_partkey AS url, 'DEEZER_SONG::'||p_size AS entity_id FROM part UNION ALL
 SELECT 'p'||p_partkey, 'apple_music', 'http://a/'||p_name, NULL FROM part WHERE p_type<>'SMALL'""")
def _(t):
    return media.external_links(payload(t.part, """named_struct('linksByPlatform', map('deezer', named_struct('url', concat('http://d/', p_partkey), 'entityUniqueId', concat('DEEZER_SONG::', p_size)),
     'appleMusic', named_struct('url', if(p_type = 'SMALL', null, concat('http://a/', p_name)), 'entityUniqueId', null), 'other', named_struct('url', 'x', 'entityUniqueId', null)))"""))


@query("external_tracks", """SELECT 'p'||p_partkey AS asset_id, p_brand AS isrc, nullif(p_size,1)::DOUBLE AS catalog_rank, p_retailprice AS bpm, '2001-02-03' AS release_date, p_name AS album, p_type AS artist, array_to_string([p_type, p_brand],'|') AS genres FROM part WHERE p_type<>'PROMO'""")
def _(t):
    return media.external_track(payload(t.part, """named_struct('error', if(p_type = 'PROMO', 'missing', null), 'isrc', p_brand, 'rank', if(p_size = 1, 0, p_size), 'bpm', p_retailprice, 'album', named_struct('id', '1', 'title', p_name, 'release_date', '2001-02-03',
     'genres', named_struct('data', array(named_struct('name', p_type), named_struct('name', p_brand)))), 'artist', named_struct('name', p_type))"""))


@query("external_listeners", "SELECT 'p'||p_partkey AS asset_id, p_size::BIGINT AS listeners, CASE WHEN p_type='LARGE' THEN NULL ELSE p_partkey END AS playcount, p_name AS url FROM part")
def _(t):
    return media.external_listeners(payload(t.part, "named_struct('track', named_struct('listeners', cast(p_size as string), 'playcount', if(p_type = 'LARGE', 'many', cast(p_partkey as string)), 'url', p_name))"))


@query("external_tags", """WITH t AS (SELECT 'p'||p_partkey AS asset_id, unnest([p_type, p_name, p_brand, p_type]) AS tag, unnest([p_size, 3, 5, 9])::BIGINT AS count FROM part), b AS (SELECT asset_id, tag, max(count) AS count FROM t GROUP BY 1,2)
SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY count DESC, tag) AS rank FROM b""")
def _(t):
    return media.external_tags(payload(t.part, "named_struct('genres', array(named_struct('name', p_type, 'count', p_size), named_struct('name', p_name, 'count', 3)), 'tags', array(named_struct('name', p_brand, 'count', 5), named_struct('name', p_type, 'count', 9)))"))


@query("external_relations", "SELECT 'p'||p_partkey AS asset_id, 'discogs' AS service, 'https://www.discogs.com/'||p_partkey AS url FROM part UNION ALL SELECT 'p'||p_partkey, 'youtube', 'https://youtube.com/'||p_size FROM part")
def _(t):
    return media.external_relations(payload(t.part, "named_struct('relations', array(named_struct('url', named_struct('resource', concat('https://www.discogs.com/', p_partkey))), named_struct('url', named_struct('resource', concat('https://youtube.com/', p_size))), named_struct('url', named_struct('resource', 'https://www.discogs.com/again'))))"))


@query("catalog_track_ids", """SELECT 'p'||p_partkey AS asset_id, p_partkey::VARCHAR AS track_id, 'https://open.spotify.com/track/'||p_partkey AS url, round(p_size/2.0,2) AS hook_s FROM part""")
def _(t):
    meta = """CASE WHEN p_size % 3 = 0 THEN named_struct('id', cast(p_partkey as string), 'uri', null, 'url', null) WHEN p_size % 3 = 1 THEN named_struct('id', null, 'uri', concat('spotify:track:', p_partkey), 'url', null)
     ELSE named_struct('id', null, 'uri', null, 'url', concat('https://open.spotify.com/track/', p_partkey, '?si=1')) END"""
    p = payload(t.part, meta).withColumnRenamed("payload", "meta")
    hooks = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("asset_id"), F.expr("to_json(array(p_size * 500, 9))").alias("hooks"))
    return p.join(hooks, "asset_id").select("asset_id", media.catalog_track_id("meta").alias("track_id"), media.catalog_track_url("meta").alias("url"), media.first_highlight("hooks").alias("hook_s"))


# labels by pairs of distinct lines, blocks by diagonals of equal labels, occurrences from the front that do not overlap
REFRAINS = r"""WITH ln AS (SELECT asset_id, i-1 AS i, lower(trim(regexp_replace(p, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text FROM (SELECT doc_id AS asset_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
wd AS (SELECT *, greatest(1, len(string_split(text, ' '))) AS words, sum(greatest(1, len(string_split(text, ' ')))) OVER (PARTITION BY asset_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY asset_id) AS n FROM ln),
fs AS (SELECT asset_id, text, min(i) AS first FROM ln GROUP BY 1,2),
lb AS (SELECT x.asset_id, x.text, coalesce(min(y.first), x.first) AS label FROM fs x LEFT JOIN fs y ON x.asset_id=y.asset_id AND y.first<x.first AND least(length(x.text),length(y.text))>=0.85*greatest(length(x.text),length(y.text))
 AND levenshtein(x.text,y.text)<=floor((1-0.85)*greatest(length(x.text),length(y.text))+1e-9) GROUP BY x.asset_id, x.text, x.first),
y AS MATERIALIZED (SELECT wd.*, label FROM wd JOIN lb USING (asset_id, text)), ys AS (SELECT asset_id, list(label ORDER BY i) AS y FROM y GROUP BY 1),
dg AS (SELECT a.asset_id, a.i, b.i AS j, a.i-row_number() OVER (PARTITION BY a.asset_id, b.i-a.i ORDER BY a.i) AS island FROM y a JOIN y b ON a.asset_id=b.asset_id AND a.label=b.label AND a.i<b.i),
rc AS (SELECT asset_id, max(reach) AS longest FROM (SELECT asset_id, least(max(i) OVER (PARTITION BY asset_id, j-i, island)-i+1, j-i) AS reach FROM dg) GROUP BY 1),
bl AS (SELECT asset_id, i, m, array_to_string(y[i+1:i+m], ',') AS block FROM (SELECT asset_id, i, n, unnest(range(1, least(longest, n-i)+1)) AS m FROM y JOIN rc USING (asset_id)) JOIN ys USING (asset_id)),
oc AS (SELECT asset_id, m, list(i ORDER BY i) AS pos FROM bl GROUP BY asset_id, m, block HAVING count(*)>1),
gr AS (SELECT *, list_reduce(list_prepend(0::BIGINT, pos), lambda acc, x: CASE WHEN acc=0 OR x>=acc%1000000-1+m THEN (acc//1000000+1)*1000000+x+1 ELSE acc END)//1000000 AS times FROM oc),
us AS (SELECT gr.*, z.upto-a.upto+a.words AS used FROM gr JOIN y a ON a.asset_id=gr.asset_id AND a.i=pos[1] JOIN y z ON z.asset_id=gr.asset_id AND z.i=pos[1]+m-1 WHERE times>=2),
bs AS (SELECT DISTINCT ON (asset_id) asset_id, m, list_reduce(list_transform(pos, lambda x: [x]), lambda acc, x: CASE WHEN x[1]>=acc[len(acc)]+m THEN list_concat(acc, x) ELSE acc END) AS picks
 FROM us WHERE used>=6 AND (m>=2 OR used>=8) ORDER BY asset_id, times*m DESC, m DESC, used DESC, pos[1])
SELECT asset_id, m AS lines, generate_subscripts(picks, 1)-1 AS occurrence, unnest(picks)::DOUBLE AS start_s FROM bs"""


@query("refrain_starts", REFRAINS)
def _(t):
    phrases = "to_json(named_struct('phrases', transform(split(text, '\\n'), (x, i) -> named_struct('phrase', x, 'start_time_in_ms', i * 1000))))"
    lyrics = t.documents.select(F.col("doc_id").alias("asset_id"), F.expr(phrases).alias("lyrics"))
    return media.refrain_starts(media.lyric_lines(lyrics))


PEAKS = f"""WITH {REELS}, c AS (SELECT song_id, date_trunc('month',taken_at)::DATE AS period, count(*) AS n FROM reels GROUP BY 1,2),
cal AS (SELECT song_id, unnest(generate_series(min(period)::TIMESTAMP,max(period)::TIMESTAMP,INTERVAL 1 MONTH))::DATE AS period FROM c GROUP BY song_id),
s AS (SELECT song_id, period, coalesce(n,0) AS n, row_number() OVER (PARTITION BY song_id ORDER BY period)-1 AS i, count(*) OVER (PARTITION BY song_id) AS periods FROM cal LEFT JOIN c USING (song_id, period)),
m AS (SELECT *, sum(step) OVER (PARTITION BY song_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN n=lag(n) OVER (PARTITION BY song_id ORDER BY i) THEN 0 ELSE 1 END AS step FROM s)),
r AS (SELECT song_id, run, (min(i)+max(i))//2 AS i, min(n) AS n, min(periods) AS periods FROM m GROUP BY 1,2),
t AS (SELECT * FROM (SELECT *, lag(n) OVER (PARTITION BY song_id ORDER BY run) AS b, lead(n) OVER (PARTITION BY song_id ORDER BY run) AS f FROM r) WHERE n>b AND n>f),
l AS (SELECT song_id, greatest(1, min(periods)//20) AS apart, list(i ORDER BY n DESC, i DESC) AS tops FROM t GROUP BY 1),
k AS (SELECT song_id, unnest(list_reduce(list_transform(tops, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: abs(q-x[1])<apart))>0 THEN acc ELSE list_concat(acc, x) END)) AS i FROM l),
e AS (SELECT song_id, stddev_pop(n) AS spread, max(n) AS top FROM s GROUP BY 1),
d AS (SELECT s.song_id, s.i, s.n, periods, (SELECT coalesce(max(x.i),-1) FROM s x WHERE x.song_id=s.song_id AND x.i<s.i AND x.n>s.n) AS a, (SELECT coalesce(min(x.i),1000000) FROM s x WHERE x.song_id=s.song_id AND x.i>s.i AND x.n>s.n) AS z
 FROM s JOIN k USING (song_id, i)),
p AS (SELECT d.song_id, d.i FROM d JOIN e USING (song_id) WHERE d.n-greatest((SELECT min(x.n) FROM s x WHERE x.song_id=d.song_id AND x.i>d.a AND x.i<=d.i),(SELECT min(x.n) FROM s x WHERE x.song_id=d.song_id AND x.i>=d.i AND x.i<d.z))>=greatest(1.0, spread)),
o AS (SELECT s.song_id, min(CASE WHEN n>=0.1*top THEN i END) AS onset, min(CASE WHEN n=top THEN i END) AS main FROM s JOIN e USING (song_id) WHERE periods>=3 AND top>0 GROUP BY 1)
SELECT song_id, strftime(period,'%Y-%m-%d') AS period, n, p.i IS NOT NULL AS is_peak, coalesce(s.i=onset,false) AS is_onset, coalesce(s.i=main,false) AS is_main_peak FROM s LEFT JOIN p USING (song_id, i) LEFT JOIN o USING (song_id)"""


@query("activity_peaks", PEAKS)
def _(t):
    return media.detect_peaks(scope.song_trend(a.reels(t.orders), "M"))
