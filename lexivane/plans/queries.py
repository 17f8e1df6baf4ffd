"""The queries of the core: name -> (spark, folder) -> DataFrame, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.functions import strings as T
from lexivane.functions import text as X
from lexivane.functions import vectors as V
from lexivane.operators import encoders, ivf, lexical, suggest
from lexivane.operators import search as S
from lexivane.operators.latency import latency_stats
from lexivane.operators.segment import keywords
from lexivane.operators.segment.cutting import Segmenter
from lexivane.operators.segment.lexicon import load_lexicon
from lexivane.operators.wordpiece import WordPiece, token_ids
from lexivane.sources import feeds, store
from lexivane.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(spark: SparkSession, folder: str) -> list[float]:
    """The standard query vector."""
    return list(table(spark, folder, "embeddings").where("vec_id = 0").first()["embedding"])


# Parts of the SQL. A product runs over the shorter of both vectors.
Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
DOT = "list_sum(list_transform(range(1, least(len({v}), len(q)) + 1), lambda i: {v}[i]::DOUBLE * q[i]::DOUBLE))"
SOUND = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0"
NEAREST = f"""(SELECT id, unnest(arg_min({{{{'c': cluster_id, 'd': d}}}}, {{{{'d': d, 'c': cluster_id}}}})) FROM (
    SELECT id, cluster_id, round(pow(list_distance(embedding::DOUBLE[], centroid::DOUBLE[]), 2), 9) AS d
    FROM (SELECT id, embedding FROM docs WHERE {SOUND}), (SELECT cluster_id, centroid FROM centroids WHERE len(centroid) = 64)) GROUP BY id)""".replace("{{", "{").replace("}}", "}")


# --- searching ---------------------------------------------------------------------------------------------------------------


@query(f"""SELECT id, title, url, content, similarity FROM (SELECT id, title, url, content, coalesce(round({DOT.format(v="embedding")}, 6), 0) AS similarity
FROM docs, {Q}) WHERE NOT isnan(similarity) ORDER BY similarity DESC, id LIMIT 10""")
def search_bruteforce_topk(spark, folder):
    docs = table(spark, folder, "docs")
    return S.fetched(S.search(docs, _q(spark, folder), 10), docs).select("id", "title", "url", "content", "similarity")


@query(f"SELECT vec_id, round({DOT.format(v='embedding')}, 6) AS similarity FROM embeddings, {Q}")
def search_all_ranked(spark, folder):
    return S.top(S.scored(table(spark, folder, "embeddings"), _q(spark, folder), key="vec_id"), -1, "vec_id")


@query(f"""WITH near AS (SELECT cluster_id FROM centroids, {Q} WHERE centroid IS NOT NULL ORDER BY list_distance(centroid::DOUBLE[], q::DOUBLE[]), cluster_id LIMIT 5)
SELECT id, similarity FROM (SELECT id, coalesce(round({DOT.format(v="embedding")}, 6), 0) AS similarity FROM docs, {Q} WHERE cluster_id IN (SELECT cluster_id FROM near))
WHERE NOT isnan(similarity) ORDER BY similarity DESC, id LIMIT 10""")
def search_ivf_topk(spark, folder):
    return S.search(table(spark, folder, "docs"), _q(spark, folder), 10, table(spark, folder, "centroids"), 5)


@query(f"""SELECT d.id, d.title, d.content, similarity FROM (SELECT id, coalesce(round({DOT.format(v="title_embedding")}, 6), 0) AS similarity FROM docs, {Q}
WHERE title_embedding IS NOT NULL AND len(title_embedding) > 0) s JOIN docs d USING (id) WHERE NOT isnan(similarity) ORDER BY similarity DESC, d.id LIMIT 50""")
def late_fetch(spark, folder):
    docs = table(spark, folder, "docs")
    return S.fetched(S.top(S.scored(docs, _q(spark, folder), "title_embedding", missing=None), 50), docs, columns=("title", "content"))


@query()
def search_json(spark, folder):
    docs = table(spark, folder, "docs")
    return S.as_json(S.fetched(S.search(docs, _q(spark, folder), 10), docs))


@query(f"""SELECT cluster_id, round(pow(list_distance(centroid::DOUBLE[], q::DOUBLE[]), 2), 6) AS distance FROM centroids, {Q}
WHERE centroid IS NOT NULL ORDER BY list_distance(centroid::DOUBLE[], q::DOUBLE[]), cluster_id LIMIT 5""")
def ivf_probe_centroids(spark, folder):
    q = F.array(*[F.lit(x) for x in _q(spark, folder)])
    rows = table(spark, folder, "centroids").where("centroid is not null").select("cluster_id", V.squared_distance(F.col("centroid"), q).alias("d"))
    return rows.orderBy("d", "cluster_id").limit(5).select("cluster_id", F.round("d", 6).alias("distance"))


# --- the index ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, c AS cluster_id, round(d, 6) AS distance FROM {NEAREST}")
def ivf_assign(spark, folder):
    a = ivf.assigned(table(spark, folder, "docs"), table(spark, folder, "centroids"))
    return a.select("id", "cluster_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT id, c AS cluster_id, round(d, 6) AS distance FROM {NEAREST}")
def ivf_assign_join(spark, folder):
    docs = table(spark, folder, "docs").where((F.size("embedding") == 64) & V.finite(F.col("embedding")))
    a = ivf.assigned_by_join(docs, table(spark, folder, "centroids").where(F.size("centroid") == 64).select("cluster_id", "centroid"))
    return a.select("id", "cluster_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT c AS cluster_id, p - 1 AS pos, round(avg(embedding[p]::DOUBLE), 6) AS x FROM (SELECT n.c, d.embedding FROM {NEAREST} n JOIN docs d USING (id)),
(SELECT unnest(range(1, 65)) AS p) GROUP BY ALL""")
def ivf_lloyd_step(spark, folder):
    docs = table(spark, folder, "docs")
    new = ivf.means(docs, ivf.assigned(docs, table(spark, folder, "centroids")))
    return new.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"SELECT count(*) FILTER (WHERE n.c IS DISTINCT FROM d.cluster_id) AS changed FROM {NEAREST} n JOIN docs d USING (id)")
def ivf_changed_count(spark, folder):
    docs = table(spark, folder, "docs")
    return ivf.changed(docs, ivf.assigned(docs, table(spark, folder, "centroids")))


@query("SELECT cluster_id, array_to_string(list_sort(list(id)), ',') AS ids FROM docs WHERE cluster_id >= 0 GROUP BY cluster_id")
def ivf_inverted_lists(spark, folder):
    lists = ivf.inverted_lists(table(spark, folder, "docs").where("cluster_id >= 0"))
    return lists.select("cluster_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT label AS cluster_id, p - 1 AS pos, round(avg(embedding[p]::DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL")
def centroids_by_label(spark, folder):
    e = table(spark, folder, "embeddings")
    m = ivf.means(e, e.select("vec_id", F.col("label").alias("cluster_id")), "vec_id")
    return m.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query()
def kmeans_train(spark, folder):
    centroids, assignment = ivf.trained(spread(table(spark, folder, "docs").select("id", "embedding")))
    return assignment.groupBy("cluster_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("distance")).join(centroids.select("cluster_id"), "cluster_id", "right").na.fill(0)


# --- vectors -----------------------------------------------------------------------------------------------------------------


@query("""SELECT id, p - 1 AS pos, round(CASE WHEN n > 1e-12 THEN embedding[p] / n ELSE embedding[p] END, 6) AS x FROM (
SELECT id, embedding::DOUBLE[] AS embedding, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM docs
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isnan(x))) = 0), (SELECT unnest(range(1, 65)) AS p) WHERE p <= len(embedding)""")
def l2_normalize(spark, folder):
    docs = table(spark, folder, "docs").where(F.col("embedding").isNotNull() & V.finite(F.col("embedding")))
    return docs.select("id", F.posexplode(V.normalized(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""WITH m AS (SELECT label, p - 1 AS pos, avg(embedding[p]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL)
SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def mean_pool(spark, folder):
    pooled = encoders.mean_of(table(spark, folder, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - q[i]::DOUBLE, 2))), 6) AS distance
FROM embeddings a, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)""")
def squared_distances(spark, folder):
    q = F.array(*[F.lit(x) for x in _q(spark, folder)])
    return table(spark, folder, "embeddings").select("vec_id", F.round(V.squared_distance(F.col("embedding"), q), 6).alias("distance"))


@query("""SELECT id, p - 1 AS pos, round(embedding[p]::DOUBLE, 6) AS x FROM docs, (SELECT unnest(range(1, 65)) AS p)
WHERE p <= len(embedding) AND len(list_filter(embedding, lambda x: isnan(x))) = 0""")
def vector_bytes(spark, folder):
    docs = table(spark, folder, "docs").where(F.col("embedding").isNotNull() & V.finite(F.col("embedding"))).select("id", V.to_bytes(F.col("embedding")).alias("b"))
    return docs.select("id", F.posexplode(V.from_bytes(F.col("b"))).alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query()
def encode_hashing(spark, folder):
    docs = encoders.encoded(table(spark, folder, "docs").select("id", "title"), encoders.HashingEncoder(), "title", "v")
    return docs.select("id", F.round(V.norm(F.col("v")), 4).alias("norm"))


# --- stored documents --------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(embedding) AS with_embedding, count(title_embedding) AS with_title_embedding, count(*) FILTER (WHERE cluster_id >= 0) AS clustered FROM docs")
def docs_stats(spark, folder):
    return store.counts(table(spark, folder, "docs"))


@query("""SELECT id, coalesce(title, '') AS title, coalesce(url, '') AS url, coalesce(cluster_id, -1) AS cluster_id FROM docs""")
def docs_migrated(spark, folder):
    return store.migrated(table(spark, folder, "docs")).select("id", "title", "url", "cluster_id")


@query(f"SELECT d.id, coalesce(n.c, d.cluster_id) AS cluster_id FROM docs d LEFT JOIN {NEAREST} n USING (id)")
def docs_reclustered(spark, folder):
    docs = table(spark, folder, "docs")
    return store.clustered(docs, ivf.assigned(docs, table(spark, folder, "centroids"))).select("id", "cluster_id")


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) AS id FROM item")
def docs_numbered(spark, folder):
    return store.numbered(table(spark, folder, "item").select("item_id"), ["item_id"]).select("item_id", "id")


# --- text --------------------------------------------------------------------------------------------------------------------


def _decode_sql(t: str) -> str:
    out = f"regexp_replace({t}, '&#[^;]{{1,8}};', chr(2), 'g')"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{sign}')"
    return f"replace({out}, chr(2), '')"


def _strip_sql(t: str) -> str:
    out = f"regexp_replace(translate({t}, chr(1) || chr(2), ''), '<[^>]*\\z', '')"
    out = f"regexp_replace(regexp_replace({out}, '<[^>]*>|>', chr(1), 'g'), '\\A\\x01+', '')"
    return _decode_sql(f"regexp_replace(regexp_replace({out}, ' \\x01+', ' ', 'g'), '\\x01+', ' ', 'g')")


@query(f"SELECT item_id, {_strip_sql('description')} AS text FROM item")
def strip_html(spark, folder):
    return table(spark, folder, "item").select("item_id", X.strip_html(F.col("description")).alias("text"))


@query(f"SELECT id, {_decode_sql('content')} AS text FROM docs")
def decode_entities(spark, folder):
    return table(spark, folder, "docs").select("id", X.decode_entities(F.col("content")).alias("text"))


@query(f"""SELECT item_id, coalesce(title, '') AS title, coalesce(link, '') AS url, {_strip_sql("CASE WHEN description <> '' THEN description ELSE content END")} AS content
FROM item WHERE coalesce(description, '') <> '' OR coalesce(content, '') <> ''""")
def feed_documents(spark, folder):
    return feeds.documents(table(spark, folder, "item").withColumn("file", F.col("item_id"))).select(F.col("file").alias("item_id"), "title", "url", "content")


@query("""SELECT item_id, coalesce(
try_strptime(regexp_replace(b, '^[A-Z][a-z]{2}, ', ''), '%d %b %Y %H:%M:%S'), try_strptime(b, '%Y-%m-%dT%H:%M:%S.%g'), try_strptime(b, '%Y-%m-%dT%H:%M:%S'), try_strptime(b, '%Y-%m-%d %H:%M:%S'),
try_strptime(b, '%Y-%m-%d %H:%M'), try_strptime(b, '%Y/%m/%d %H:%M:%S'), try_strptime(b, '%Y-%m-%d'), TIMESTAMP '2026-01-01 00:00:00')::VARCHAR AS published
FROM (SELECT item_id, regexp_replace(trim(pubdate), '\\s*(?:Z|GMT|UTC|[+-]\\d{2}:?\\d{2})$', '') AS b FROM item)""")
def feed_dates(spark, folder):
    dated = feeds.dated(table(spark, folder, "item"), "2026-01-01 00:00:00", "pubdate")
    return dated.select("item_id", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query()
def repaired_titles(spark, folder):
    return table(spark, folder, "item").select("item_id", X.repaired(F.col("title")).alias("title"))


_WORDS = "regexp_extract_all(title, '([A-Za-z0-9_\\-\\x{4E00}-\\x{9FFF}]+)', 1)"


@query(f"SELECT id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM (SELECT id, {_WORDS} AS w FROM docs)")
def title_words(spark, folder):
    return table(spark, folder, "docs").select("id", F.posexplode(X.title_words(F.col("title"))).alias("pos", "word"))


@query("SELECT item_id, levenshtein(i.title, c.title) AS distance FROM item i JOIN channel c USING (channel_id)")
def byte_distances(spark, folder):
    i = table(spark, folder, "item").select("item_id", "channel_id", F.col("title").alias("t"))
    c = table(spark, folder, "channel").select("channel_id", F.col("title").alias("u"))
    return i.join(c, "channel_id").select("item_id", X.byte_distance(F.col("t"), F.col("u")).alias("distance"))


_CJK = f"([{X.CJK}])"


@query(f"SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(title, '{_CJK}', ' \\1 ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), '|') AS tokens FROM docs")
def cjk_pad_tokens(spark, folder):
    return table(spark, folder, "docs").select("id", F.array_join(X.split_ascii_space(X.pad_cjk(F.col("title"))), "|").alias("tokens"))


@query("SELECT item_id, array_to_string(list_filter(string_split(author, ' '), lambda x: x <> ''), '|') AS parts FROM item")
def split_spaces(spark, folder):
    return table(spark, folder, "item").select("item_id", F.array_join(X.split_single_space(F.col("author")), "|").alias("parts"))


@query("SELECT id, replace(url_encode(title || ' ' || url), '%20', '+') AS encoded, title || ' ' || url AS decoded FROM docs")
def url_codes(spark, folder):
    both = F.concat("title", F.lit(" "), "url")
    encoded = X.url_encode(both)
    return table(spark, folder, "docs").select("id", encoded.alias("encoded"), X.url_decode(encoded).alias("decoded"))


@query("SELECT id, title AS text FROM docs")
def http_queries(spark, folder):
    target = F.concat(F.lit("/search?x=1&keywords="), X.url_encode(F.col("title")), F.lit("&q=other"))
    return table(spark, folder, "docs").select("id", X.query_text(target).alias("text"))


@query("""SELECT channel_id, upper(title) AS upper, lower(title) AS lower, string_split(link, '/')[3] AS host, starts_with(link, 'https') AS secure, rtrim(link, '/') || '/feed.xml' AS path,
octet_length(encode(title)) AS bytes FROM channel""")
def string_helpers(spark, folder):
    c = table(spark, folder, "channel")
    host = F.get(T.split_at(F.col("link"), "/"), F.lit(2))
    return c.select("channel_id", F.upper("title").alias("upper"), F.lower("title").alias("lower"), host.alias("host"), T.starts(F.col("link"), "https").alias("secure"), T.path_joined(F.col("link"), F.lit("feed.xml")).alias("path"), F.octet_length(T.encoded(F.col("title"), "UTF-8")).alias("bytes"))


@query()
def transcoded(spark, folder):
    both = T.decoded(T.encoded(F.col("title"), "gb18030"), "gb18030")
    return table(spark, folder, "channel").select("channel_id", (both == F.col("title")).alias("same"))


# --- words and suggestions ---------------------------------------------------------------------------------------------------

_TITLES = f"""SELECT id, title, similarity FROM (SELECT id, title, coalesce(round({DOT.format(v="title_embedding")}, 6), 0) AS similarity FROM docs, {Q}
WHERE title_embedding IS NOT NULL AND len(title_embedding) > 0) WHERE NOT isnan(similarity) ORDER BY similarity DESC, id LIMIT 50"""
_SEM = f"SELECT word, sum(similarity) AS total, count(*) AS n, sum(similarity) * ln(1 + count(*)) AS score FROM (SELECT similarity, unnest({_WORDS}) AS word FROM ({_TITLES}) WHERE title <> '') GROUP BY word"


def _titles(spark, folder):
    docs = table(spark, folder, "docs")
    return S.top(S.scored(docs, _q(spark, folder), "title_embedding", missing=None), 50).join(docs.select("id", "title"), "id")


@query(f"SELECT word, round(total, 6) AS total, n, round(score, 6) AS score FROM ({_SEM})")
def word_stats(spark, folder):
    w = suggest.word_scores(_titles(spark, folder))
    return w.select("word", F.round("total", 6).alias("total"), F.col("count").alias("n"), F.round("score", 6).alias("score"))


@query("SELECT word, count(*) AS n FROM (SELECT split_part(title, ' ', 1) AS word FROM item WHERE title IS NOT NULL) WHERE octet_length(encode(word)) BETWEEN 1 AND 30 GROUP BY word")
def dictionary_load(spark, folder):
    return lexical.dictionary(table(spark, folder, "item"), "title").groupBy("word").agg(F.count("*").alias("n"))


_DICT = "SELECT split_part(title, ' ', 1) AS word FROM item WHERE title IS NOT NULL AND octet_length(encode(split_part(title, ' ', 1))) BETWEEN 1 AND 30"
_NEAR = "encode(word)[1:1] = encode({q})[1:1] AND abs(octet_length(encode(word)) - octet_length(encode({q}))) <= octet_length(encode({q})) // 2 + 1"
_SCORE = "(1::FLOAT - (levenshtein(word, {q})::FLOAT / greatest(octet_length(encode(word)), octet_length(encode({q})))::FLOAT)::FLOAT)::FLOAT"


def _find_sql(q: str, k: int) -> str:
    return f"SELECT word, {_SCORE.format(q=q)} AS score FROM ({_DICT}) WHERE {_NEAR.format(q=q)} AND {_SCORE.format(q=q)} > 0.3::FLOAT ORDER BY score DESC, word LIMIT {k}"


@query(f"SELECT word, round(score::DOUBLE, 6) AS score FROM ({_find_sql(chr(39) + 'Tandro' + chr(39), 20)})")
def lexical_find(spark, folder):
    found = lexical.find(lexical.dictionary(table(spark, folder, "item"), "title"), "Tandro", 20)
    return found.select("word", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"SELECT word, round(score::DOUBLE, 6) AS score FROM ({_find_sql(chr(39) + '时隔4年' + chr(39), 20)})")
def lexical_find_chinese(spark, folder):
    found = lexical.find(lexical.dictionary(table(spark, folder, "item"), "title"), "时隔4年", 20)
    return found.select("word", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"""SELECT query, word, round(score::DOUBLE, 6) AS score, rank FROM (SELECT query, word, {_SCORE.format(q="query")} AS score, row_number() OVER (PARTITION BY query ORDER BY {_SCORE.format(q="query")} DESC, word) AS rank
FROM (SELECT DISTINCT word FROM ({_DICT})), (SELECT DISTINCT split_part(title, ' ', 1) AS query FROM channel WHERE title <> '') WHERE {_NEAR.format(q="query")} AND {_SCORE.format(q="query")} > 0.3::FLOAT) WHERE rank <= 5""")
def lexical_batch(spark, folder):
    words = lexical.dictionary(table(spark, folder, "item"), "title").distinct()
    asked = table(spark, folder, "channel").select(F.substring_index("title", " ", 1).alias("query"))
    return lexical.find_many(words, asked, 5).select("query", "word", F.round(F.col("score").cast("double"), 6).alias("score"), "rank")


@query(f"""WITH near AS (SELECT cluster_id FROM centroids, {Q} WHERE centroid IS NOT NULL ORDER BY list_distance(centroid::DOUBLE[], q::DOUBLE[]), cluster_id LIMIT 10),
sem AS ({_SEM.replace("WHERE title_embedding IS NOT NULL", "WHERE cluster_id IN (SELECT cluster_id FROM near) AND title_embedding IS NOT NULL")}),
lex AS (SELECT word, max(score)::DOUBLE AS score FROM ({_find_sql(chr(39) + "After" + chr(39), 30)}) GROUP BY word), most AS (SELECT greatest(max(score), 0) AS m FROM sem)
SELECT word, round(0.5 * coalesce(lex.score, 0) + 0.5 * coalesce(CASE WHEN m > 0 THEN sem.score / m ELSE 0 END, 0), 6) AS score FROM lex FULL JOIN sem USING (word), most ORDER BY score DESC, word LIMIT 10""")
def suggest_fused(spark, folder):
    words = lexical.dictionary(table(spark, folder, "item"), "title")
    return suggest.suggest(table(spark, folder, "docs"), words, "After", _q(spark, folder), 10, table(spark, folder, "centroids"))


# --- keywords ----------------------------------------------------------------------------------------------------------------

_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+|[\\x{4E00}-\\x{9FFF}]{2}')) AS word FROM documents"


def _words(spark, folder):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+|[\\x{4E00}-\\x{9FFF}]{2}"), F.lit(0))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(tokens).alias("offset", "word"))


@query(f"""WITH t AS ({_TOKENS}), n AS (SELECT count(*) AS n FROM documents), d AS (SELECT word, ln((SELECT n FROM n)::DOUBLE / count(DISTINCT doc_id)) AS idf FROM t GROUP BY word),
c AS (SELECT doc_id, word, round(count(*) * idf, 6) AS weight FROM t JOIN d USING (word) WHERE length(word) > 1 GROUP BY doc_id, word, idf)
SELECT doc_id, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS r FROM c) WHERE r <= 10""")
def keyword_tfidf(spark, folder):
    words = _words(spark, folder)
    total = table(spark, folder, "documents").count()
    idf = words.select("doc_id", "word").distinct().groupBy("word").agg(F.log(F.lit(float(total)) / F.count("*")).alias("idf"))
    found = keywords.tf_idf(words, idf, 1.0, None, 10**6, "doc_id").withColumn("weight", F.round("weight", 6))
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "word"))
    return found.withColumn("r", r).where("r <= 10").select("doc_id", "word", "weight")


def _segmenter(spark, folder) -> Segmenter:
    """A lexicon of the pairs of Han characters in the channels' texts and titles: a fixed table."""
    text = F.concat_ws(" ", "title", "description")
    pairs = table(spark, folder, "channel").select(F.explode(F.regexp_extract_all(text, F.lit("[\\x{4E00}-\\x{9FFF}]{2}"), F.lit(0))).alias("w"))
    rows = pairs.groupBy("w").agg(F.count("*").alias("n")).orderBy("w").collect()
    return Segmenter(load_lexicon([f"{r['w']} {r['n']} n" for r in rows]))


def _segment(spark, folder, kind):
    docs = spread(table(spark, folder, "docs").select("id", "title"))
    out = keywords.segmented(docs, _segmenter(spark, folder), kind, "id", "title")
    return out.select("id", F.array_join("words", "|").alias("words"))


@query()
def segment_mp(spark, folder):
    return _segment(spark, folder, "mp")


@query()
def segment_full(spark, folder):
    return _segment(spark, folder, "full")


@query()
def segment_query(spark, folder):
    return _segment(spark, folder, "query")


@query()
def segment_tags(spark, folder):
    docs = spread(table(spark, folder, "docs").select("id", "title"))
    return keywords.located(docs, _segmenter(spark, folder), "id", "title")


@query()
def textrank(spark, folder):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+|[\\x{4E00}-\\x{9FFF}]{2}"), F.lit(0))
    words = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", tokens.alias("words"))
    return keywords.text_rank(words, top=5, key="doc_id").select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query()
def wordpiece_ids(spark, folder):
    words = table(spark, folder, "channel").select(F.explode(F.split(F.lower(F.concat_ws(" ", "title", "description", "generator")), "")).alias("c")).where("c <> ''").distinct().orderBy("c")
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *[p + r["c"] for r in words.collect() for p in ("", "##")]]
    tokenizer = WordPiece({t: k for k, t in enumerate(tokens)})
    return table(spark, folder, "docs").select("id", F.size(token_ids(F.col("title"), tokenizer)).alias("n"))


# --- statistics --------------------------------------------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.9)::INT + 1] AS p90,
list_sort(list(value))[floor(count(*) * 0.99)::INT + 1] AS p99, max(value) AS max, count(*) / 20.0 AS per_second FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency(spark, folder):
    return latency_stats(table(spark, folder, "events"), "value", 20.0, "event_type").withColumn("mean", F.round("mean", 6))


