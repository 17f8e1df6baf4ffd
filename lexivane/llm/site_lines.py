"""Problem 6: lines repeated across one site's documents.

The rate of each line within its site is compared with its rate outside by the log-likelihood ratio, with control of the
false-discovery rate over all lines tested. A line is boilerplate of a site if its excess is significant and it occurs in at
least ``least_rows`` rows and ``least_share`` of the site's rows. A line that is boilerplate on many sites would hide
itself by its rate on the others; so the outside rate is taken over the sites where it stays under those two bounds.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.session import written

#: White space beyond what Java's \\s covers: no-break, ideographic and other Unicode spaces, and the zero-width no-break space.
SPACE_OR_DIGIT = "[\\s\\x{0085}\\x{001C}-\\x{001F}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}0-9]+"
#: Bins of one thousandth of a power of ten for the p-values; those below 1e-300 share the last.
BINS = 300_000


def site_of(url: Column) -> Column:
    """The host in lower case, without port and without a leading www. or m.; null where there is none."""
    rest = F.regexp_replace(F.trim(url), "^[a-zA-Z][a-zA-Z0-9+.-]*:(?=//)", "")
    host = F.lower(F.regexp_extract(rest, "^(?://)?(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, "^(?:www\\.|m\\.)", "")
    return F.when(F.length(host) > 0, host)


def line_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, SPACE_OR_DIGIT, ""))


def _keyed(docs: DataFrame, least_length: int) -> DataFrame:
    """id, site, keys: for each line the 64-bit hash of what counts of it, null for a line too short to count."""

    def key(line: Column) -> Column:
        k = line_key(line)
        return F.when(F.length(k) >= least_length, F.xxhash64(k))

    return docs.select(F.col("id").cast("long").alias("id"), site_of(F.col("url")).alias("site"), F.transform(F.split(F.col("content"), "\n", -1), key).alias("keys"))


def _tail(ratio: pd.Series) -> pd.Series:
    """Thousandths of the power of ten of the chi-square tail, one degree of freedom; beyond the floats by its asymptote."""

    def one(x: float) -> int:
        p = math.erfc(math.sqrt(max(x, 0.0) / 2))
        power = -math.log10(p) if p > 0 else (x / 2 + 0.5 * math.log(max(x, 1.0) * math.pi / 2)) / math.log(10)
        return min(BINS, int(power * 1000))

    return ratio.map(one).astype("int32")


def repeated_lines(docs: DataFrame, least_rows: int = 5, least_share: float = 0.05, least_length: int = 6, false_discovery: float = 0.05) -> DataFrame:
    """site, key, n_rows, n_site, outside_rate, ratio: the boilerplate lines of each site of ``docs`` (id, url, content).

    A line counts once a row. Rows without a site, and null contents, hold no lines; but every row of a site counts in its
    size. Lines of fewer than ``least_length`` characters without white space and digits are never boilerplate.
    The result is a written table. An id is taken to be one row.
    """
    keyed = _keyed(docs, least_length).where("site is not null")
    sites = keyed.groupBy("site").agg(F.count("*").alias("n_site"))
    lines = keyed.select("site", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    counts = written(lines.groupBy("site", "key").agg(F.count("*").alias("n_rows")), "lines")
    often = counts.where(F.col("n_rows") >= least_rows).join(sites, "site")
    often = written(often.withColumn("over", F.col("n_rows") >= least_share * F.col("n_site")), "often")
    total = sites.agg(F.sum("n_site")).first()[0] or 0
    # Outside: everything of the key, less the sites where it is over both bounds.
    tested = often.where("over")
    all_of = counts.join(tested.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("n_rows").alias("n_all"))
    over_of = tested.groupBy("key").agg(F.sum("n_rows").alias("n_over"), F.sum("n_site").alias("s_over"))
    x = tested.join(all_of, "key").join(over_of, "key")
    x = x.select("site", "key", "n_rows", "n_site", (F.col("n_all") - F.col("n_over")).alias("n_out"), (F.lit(total) - F.col("s_over")).alias("s_out"))
    x = x.withColumn("outside_rate", F.col("n_out") / F.greatest(F.col("s_out"), F.lit(1)))

    def part(n: Column, of: Column, expected: Column) -> Column:
        """n ln(n / expected) of the share n of ``of``, 0 where n is 0."""
        return F.when(n > 0, n * F.log(n / (of * expected))).otherwise(0.0)

    n, s, no, so = (F.col(c).cast("double") for c in ("n_rows", "n_site", "n_out", "s_out"))
    # Half a row is added outside, so that a line found nowhere else, or a single site, has a rate to compare with.
    no, so = no + 0.5, F.greatest(so, s) + 1.0
    rate = (n + no) / (s + so)
    ratio = 2 * (part(n, s, rate) + part(s - n, s, 1 - rate) + part(no, so, rate) + part(so - no, so, 1 - rate))
    x = written(x.withColumn("ratio", F.when(n / s > no / so, ratio).otherwise(0.0)).withColumn("power", F.pandas_udf(_tail, "int")("ratio")), "tested")
    # Benjamini and Hochberg over the bins of the p-values; every line with enough rows in its site is a test.
    bins = sorted((r["power"], r["n"]) for r in x.groupBy("power").agg(F.count("*").alias("n")).collect())
    tests, seen, cut = often.count(), 0, None
    for power, n in reversed(bins):
        seen += n
        if 10 ** (-power / 1000) <= false_discovery * seen / max(tests, 1):
            cut = power
    return x.where(F.col("power") >= cut if cut is not None else F.lit(False)).select("site", "key", "n_rows", "n_site", "outside_rate", "ratio")


def line_cases(docs: DataFrame, lines: DataFrame, least_length: int = 6) -> DataFrame:
    """id, line_no of the lines of ``docs`` that are in ``lines``."""
    at = _keyed(docs, least_length).where("site is not null").select("id", "site", F.posexplode("keys").alias("line_no", "key")).where("key is not null")
    return at.join(lines.select("site", "key"), ["site", "key"], "left_semi").select("id", "line_no")


def without_lines(docs: DataFrame, lines: DataFrame, least_length: int = 6) -> DataFrame:
    """id, content, removed: the contents without the lines in ``lines``, the others in their order; a row without any is kept whole."""
    cases = line_cases(docs, lines, least_length).groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    joined = docs.select(F.col("id").cast("long").alias("id"), "content").join(cases, "id", "left")
    kept = F.filter(F.split("content", "\n", -1), lambda _, k: ~F.array_contains("gone", k))
    return joined.select("id", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
