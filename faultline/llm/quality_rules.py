"""Quality rules with adaptive thresholds per language and source; DataFrame operations only.

Each rate of a document is a whole number of thousandths. A quantile sketch is a
table (language, source, rate, bucket, count) of log-linear buckets: a value
keeps its highest SKETCH_BITS bits, so a quantile is within 1/64 of itself.
Sketches merge by adding counts: those of sources give those of languages and of
the whole table without another pass. A document is dropped if a rate is over
median + SPREADS * (median - 10th percentile) + slack of its group. Groups of
under MIN_ROWS documents take their language's thresholds, small languages those
of the whole table. Documents that fail the fixed base rule are not in sketches.

Cases: null text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows count each; an empty table gives
an empty result; a table where all fail the base rule has no thresholds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .text_stats import text_stats

#: Rates in thousandths: numerator, denominator, slack in thousandths.
RATES = {
    "symbols": ("n_symbols", "n_words", 200),
    "repeats": ("n_repeat_words", "n_words", 300),
    "dup_lines": ("n_dup_lines", "n_lines", 300),
    "word_length": ("word_chars", "n_words", 1500),
}
SKETCH_BITS = 7
SPREADS = 3
MIN_ROWS = 100


def rate(name: str) -> Column:
    top, bottom, _ = RATES[name]
    return F.expr(f"(1000 * {top}) div greatest({bottom}, 1)")


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket."""
    low = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return (value - F.pmod(value, F.pow(F.lit(2.0), low).cast("long"))).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(stats: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rate, bucket, n); counts are combined before the shuffle, so a hot group costs no more than others."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bucket(F.col(f"r_{k}")).alias("bucket")) for k in RATES]))
    return stats.select(*groups, each.alias("e")).groupBy(*groups, "e.rate", "e.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "rate", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rows, t_<rate>): the highest rate that each group accepts. A group has some hundred buckets a rate."""
    w = Window.partitionBy(*groups, "rate")
    upto = F.sum("n").over(w.orderBy("bucket"))
    held = sketch.withColumns({"upto": upto, "rows": F.sum("n").over(w)})
    at = lambda pct: F.min(F.when(100 * F.col("upto") >= pct * F.col("rows"), F.col("bucket")))
    q = held.groupBy(*groups, "rate").agg(F.max("rows").alias("rows"), at(50).alias("mid"), at(10).alias("low"))
    slack = reduce(lambda c, k: c.when(F.col("rate") == k, RATES[k][2]), RATES, F)
    q = q.withColumn("most", F.col("mid") + SPREADS * (F.col("mid") - F.col("low")) + slack)
    return q.groupBy(*groups).agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("rate") == k, F.col("most"))).alias(f"t_{k}") for k in RATES])


def adaptive_filter(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """Verdict of every row: id, lang, source, statistics, base_failed, kept."""
    s = text_stats(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), s.alias("s")).select("id", "lang", "source", "s.*")
    stats = staged(rows.withColumns({f"r_{k}": rate(k) for k in RATES} | {"base_failed": base_failed()}), "stats")
    fine = staged(sketches(stats.filter("not base_failed"), ["lang", "source"]), "sketches")
    by_lang = merged(fine, ["lang"])
    levels = []
    for name, sketch, keys in (("s", fine, ["lang", "source"]), ("l", by_lang, ["lang"]), ("a", merged(by_lang, []), [])):
        t = thresholds(sketch, keys)
        levels.append(t.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct("rows", *[f"t_{k}" for k in RATES]).alias(f"{name}_t")))
    per_source, per_lang, overall = levels
    groups = stats.select("lang", "source").distinct()
    chosen = groups.join(per_source, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
    chosen = chosen.join(per_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(overall), F.lit(True), "left")
    enough = lambda name: F.when(F.col(f"{name}_t.rows") >= min_rows, F.col(f"{name}_t"))
    chosen = chosen.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.coalesce(enough("s"), enough("l"), F.col("a_t")).alias("t"))
    joined = stats.join(staged(chosen, "thresholds"), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    within = reduce(lambda a, b: a & b, [F.col(f"r_{k}") <= F.col(f"t.t_{k}") for k in RATES])
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') AS ls FROM t),
pos AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM pos),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM dup) GROUP BY rid),
s AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(translate(t, {_WS}, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
r AS (SELECT rid, lang, source, base_failed, unnest([struct_pack(rate := 'symbols', v := 1000 * n_symbols // greatest(n_words, 1), slack := 200),
  struct_pack(rate := 'repeats', v := 1000 * n_repeat_words // greatest(n_words, 1), slack := 300),
  struct_pack(rate := 'dup_lines', v := 1000 * n_dup_lines // greatest(n_lines, 1), slack := 300),
  struct_pack(rate := 'word_length', v := 1000 * word_chars // greatest(n_words, 1), slack := 1500)]) AS e FROM f),
b AS (SELECT lang, source, e.rate AS rate, e.slack AS slack, e.v - e.v % (1::BIGINT << greatest(length(bin(e.v)) - 7, 0)::INT) AS bucket FROM r WHERE NOT base_failed),
g AS (SELECT 1 AS lvl, lang, source, rate, slack, bucket FROM b UNION ALL SELECT 2, lang, NULL, rate, slack, bucket FROM b UNION ALL SELECT 3, NULL, NULL, rate, slack, bucket FROM b),
q AS (SELECT lvl, lang, source, rate, count(*) AS n, quantile_disc(bucket, 0.5) AS mid, quantile_disc(bucket, 0.1) AS low, any_value(slack) AS slack FROM g GROUP BY ALL),
m AS (SELECT lvl, lang, source, rate, n, mid + 3 * (mid - low) + slack AS most FROM q),
v AS (SELECT r.rid, bool_and(r.e.v <= coalesce(m1.most, m2.most, m3.most)) AS ok FROM r
  LEFT JOIN m m1 ON m1.lvl = 1 AND m1.n >= 100 AND m1.rate = r.e.rate AND m1.lang IS NOT DISTINCT FROM r.lang AND m1.source IS NOT DISTINCT FROM r.source
  LEFT JOIN m m2 ON m2.lvl = 2 AND m2.n >= 100 AND m2.rate = r.e.rate AND m2.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN m m3 ON m3.lvl = 3 AND m3.rate = r.e.rate GROUP BY r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, false) AS kept FROM f JOIN v USING (rid)
"""
