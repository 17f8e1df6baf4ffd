"""The queries of this subpackage: name -> (spark, folder) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivane.llm import abuse, markup, mixing, mixture, multi_index, neardup, packing, site_lines, tokens, truncation
from lexivane.session import written
from lexivane.tables import spread
from lexivane.tables import table as read


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(read(spark, folder, name)) if name in ("docs", "item", "documents") else read(spark, folder, name)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_pairs(*neardup.near_duplicates(table(spark, folder, "docs")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_classes(*neardup.near_duplicates(table(spark, folder, "docs")))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """tbl, rec_id, host, text of docs.content (host: the site) and item.description (host: the channel)."""
    docs = table(spark, folder, "docs").select(F.lit("docs").alias("tbl"), F.col("id").alias("rec_id"), site_lines.site_of(F.col("url")).alias("host"), F.col("content").alias("text"))
    item = table(spark, folder, "item").select(F.lit("item").alias("tbl"), F.col("item_id").alias("rec_id"), F.col("channel_id").cast("string").alias("host"), F.col("description").alias("text"))
    return docs.unionByName(item)


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with rec_id as tbl:id."""
    return _texts(spark, folder).select(F.concat_ws(":", "tbl", "rec_id").alias("rec_id"), F.concat_ws(":", "tbl", "host").alias("host"), "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = markup.markup_records(_marked(spark, folder))
    parts = F.split("rec_id", ":")
    return found.select(parts[0].alias("tbl"), parts[1].cast("long").alias("rec_id"))


def p2_templates(spark: SparkSession, folder: str) -> DataFrame:
    return markup.template_classes(_marked(spark, folder))


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.cleaned(_marked(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.cluster_rows(mixture.mixture_clusters(table(spark, folder, "docs")), 5)


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.cluster_summary(mixture.mixture_clusters(table(spark, folder, "docs")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "docs")
    near = [multi_index.with_enough(multi_index.most_similar(docs, "id", f, 5, least=0.82), 5).select(F.lit(f).alias("field"), "id", "near_id") for f in ("embedding", "title_embedding")]
    return near[0].unionByName(near[1])


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.most_similar(table(spark, folder, "docs"), "id", "embedding", 10, every=20)


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id (twice the id, odd for items), source, title, text of docs and item."""
    docs = table(spark, folder, "docs").select((F.col("id") * 2).alias("rec_id"), F.concat(F.lit("site "), site_lines.site_of(F.col("url"))).alias("source"), "title", F.col("content").alias("text"))
    item = table(spark, folder, "item").select((F.col("item_id") * 2 + 1).alias("rec_id"), F.concat(F.lit("channel "), F.col("channel_id").cast("string")).alias("source"), "title", F.col("description").alias("text"))
    return docs.unionByName(item)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = truncation.truncated(_numbered(spark, folder))
    return cut.select(F.when(F.col("rec_id") % 2 == 0, "docs").otherwise("item").alias("tbl"), F.floor(F.col("rec_id") / 2).cast("long").alias("rec_id"))


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    records = _numbered(spark, folder)
    return truncation.truncation_rates(records, truncation.truncated(records))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "docs")
    return site_lines.line_cases(docs, site_lines.repeated_lines(docs))


def p6_lines(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, folder, "docs"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "docs")
    return site_lines.without_lines(docs, site_lines.repeated_lines(docs))


def _packings(spark: SparkSession, folder: str) -> list[tuple[str, int, DataFrame]]:
    sized = written(tokens.sized(table(spark, folder, "documents")), "sizes")
    limits = table(spark, folder, "pack_limits").where("capacity_tokens > 0").orderBy("capacity_tokens", "container").collect()  # one row a kind of container
    return [(r["container"], r["capacity_tokens"], packing.packed(sized, r["capacity_tokens"])) for r in limits]


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    placed = [p.select(F.lit(name).alias("container"), "*") for name, _, p in _packings(spark, folder)]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def p7_unused(spark: SparkSession, folder: str) -> DataFrame:
    reports = [packing.packing_report(p, c).select(F.lit(name).alias("container"), "*") for name, c, p in _packings(spark, folder)]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def _uses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    sized = written(tokens.sized(table(spark, folder, "documents"), tokens.TOKENIZER, "source"), "sizes")
    return mixing.record_uses(sized, targets), targets


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_uses(spark, folder)[0])


def p8_uses(spark: SparkSession, folder: str) -> DataFrame:
    return _uses(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_uses(spark, folder))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, folder, "documents"), table(spark, folder, "review_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).where("abusive").select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder)


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.source_rates(table(spark, folder, "documents"), _scores(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}



_UNIT = "(SELECT id, list_transform({v}, lambda x: x::DOUBLE / n) AS v FROM (SELECT id, {v}, sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM docs WHERE len({v}) = 64 AND len(list_filter({v}, lambda x: NOT isfinite(x))) = 0) WHERE n > 0)"
_RUNS = r"regexp_extract_all(regexp_replace(lower({t}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
_PAIRS = f"""SELECT id, w[i] || ' ' || w[i + 1] AS pair, count(*) AS n FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM (
SELECT id, {_RUNS.format(t="coalesce(title, '') || chr(10) || content")} AS w FROM docs WHERE len({_RUNS.format(t="content")}) >= 20)) GROUP BY ALL"""
_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^(?:www\\.|m\\.)', '')"
_LINES = f"""l AS (SELECT id, site, i - 1 AS line_no, c[i] AS line, lower(regexp_replace(c[i], '[\\s0-9\\x{{00A0}}\\x{{3000}}]+', '', 'g')) AS k FROM (
SELECT id, site, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT id, {_SITE} AS site, string_split(content, chr(10)) AS c FROM docs WHERE url <> ''))),
s AS (SELECT {_SITE} AS site, count(*) AS n FROM docs WHERE url <> '' GROUP BY 1), o AS (SELECT site, k, count(DISTINCT id) AS rows FROM l WHERE length(k) >= 6 GROUP BY site, k),
cases AS (SELECT l.id, l.line_no FROM l JOIN o USING (site, k) JOIN s USING (site) WHERE o.rows >= 5 AND o.rows >= 0.05 * s.n)"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the result over whole tables in time."""
    near = "SELECT '{v}' AS field, a.id, b.id AS near_id, round(list_inner_product(a.v, b.v), 6) AS c FROM {u} a JOIN {u} b ON a.id <> b.id AND list_inner_product(a.v, b.v) >= 0.82"
    both = " UNION ALL ".join(near.format(v=v, u=_UNIT.format(v=v)) for v in ("embedding", "title_embedding"))
    unit = _UNIT.format(v="embedding")
    return {
        "p1_found": f"""WITH p AS ({_PAIRS}), t AS (SELECT id, sum(n) AS t FROM p GROUP BY id), o AS (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.n, b.n)) AS o FROM p a JOIN p b ON a.pair = b.pair AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM o JOIN t x ON x.id = id_a JOIN t y ON y.id = id_b WHERE o >= 0.55 * greatest(x.t, y.t)""",
        "p3_found": f"SELECT a.id, min(b.id) AS rep_id FROM {unit} a JOIN {unit} b ON list_inner_product(a.v, b.v) >= 0.82 GROUP BY a.id HAVING count(*) >= 5",
        "p4_found": f"SELECT field, id, near_id FROM (SELECT *, row_number() OVER (PARTITION BY field, id ORDER BY c DESC, near_id) AS r, count(*) OVER (PARTITION BY field, id) AS n FROM ({both})) WHERE r <= 5 AND n >= 5",
        "p6_found": f"WITH {_LINES} SELECT id, line_no FROM cases",
        "p6_clean": f"""WITH {_LINES}, g AS (SELECT id, list(line_no) AS gone FROM cases GROUP BY id)
SELECT id, CASE WHEN gone IS NULL THEN content ELSE (SELECT array_to_string(list(c[i] ORDER BY i), chr(10)) FROM (SELECT unnest(range(1, len(c) + 1)) AS i) WHERE NOT list_contains(gone, i - 1)) END AS content, coalesce(len(gone), 0) AS removed
FROM (SELECT d.id, d.content, string_split(d.content, chr(10)) AS c, g.gone FROM docs d LEFT JOIN g USING (id))""",
    }
