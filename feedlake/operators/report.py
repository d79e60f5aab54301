"""The analytics report and its single-measure parts.

``analytics_report`` answers every section in one scan: each row is exploded
into the ``(section, key)`` cells it contributes to, one hash aggregate with
map-side partials counts them, and the ranked sections are pruned to the top
``n`` by a ``row_number`` filter (planned as WindowGroupLimit, which keeps
``n`` rows per section inside each task before the only small exchange).
Fixed buckets and the overall row are seeded with weight-0 rows *before* the
aggregate, so they exist even when nothing falls in them or the input is
empty. No row cap: the whole table is analysed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Score bucket upper edges (left-closed, the top bucket is
# open-ended), their labels, the length of the top lists and the places of
# the average.
SCORE_EDGES = (3, 7, 9)
SCORE_LABELS = ("0-3", "3-7", "7-9", "9-10")
TOP_N = 10
AVERAGE_PLACES = 2
FACET_TOP = 200

SEC_TOTAL, SEC_SEVERITY, SEC_BUCKET = "total", "severity", "score_bucket"
UNSUMMED = "unsummed"
SEC_AVERAGE, SEC_TERMS, SEC_LABELS = "average_score", "top_technologies", "top_components"
SEC_LINKS, SEC_DATES, SEC_ALL = "with_links", "date_range", "all"

# Scores are summed as whole 1e-4 units: exact and independent of row order
# (unlike a double sum). A unit count is a bigint and their sum a decimal(38,0),
# which 10^19 rows of the largest score cannot overflow.
SCORE_UNITS = 10_000
UNITS_TYPE = "decimal(28,0)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def bucket_of(score: Column, edges=SCORE_EDGES, labels=SCORE_LABELS) -> Column:
    """Label of the left-closed bucket of a numeric score (no upper check)."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    expr = None
    for edge, label in zip(edges, labels):
        test = score < F.lit(edge)
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def score_units(sc: Column) -> Column:
    """A numeric score as whole 1e-4 units (half-up at the 4th place); NULL
    for a value no bigint can hold (±inf, |x| > 9.2e14), which the mean skips
    and counts as unsummed."""
    return F.round(sc * F.lit(float(SCORE_UNITS))).try_cast("bigint")


def _mean_columns(units_sum: str, scored: str, places: int = AVERAGE_PLACES):
    """(value, text) of the mean of scores, from the names of the column with
    their sum in 1e-4 units and of the column with their count.

    Rounded half-up (away from zero) to ``places`` in exact long arithmetic
    (SQL ``div``), so no intermediate rounding can move a value across a
    half: m = sign(S) * ((2|S| + D) div 2D) with D = n * 10^(4 - places).
    0 / '0' when nothing scored.
    """
    d = f"({scored} * {10 ** (4 - places)})"
    m = (f"(CASE WHEN {units_sum} < 0 THEN -1 ELSE 1 END) * "
         f"((2 * abs({units_sum}) + {d}) div (2 * {d}))")
    scale = 10 ** places
    value = F.expr(f"CASE WHEN {scored} > 0 THEN cast({m} AS DOUBLE) / cast({scale} AS DOUBLE) "
                   f"ELSE cast(0 AS DOUBLE) END")
    text = F.expr(f"CASE WHEN {scored} > 0 THEN concat(CASE WHEN {m} < 0 THEN '-' ELSE '' END, "
                  f"cast(abs({m}) div {scale} AS STRING), '.', "
                  f"lpad(cast(abs({m}) % {scale} AS STRING), {places}, '0')) ELSE '0' END")
    return value, text


# ---- the one-pass report -------------------------------------------------

_CELL = "struct<section:string,key:string,w:bigint,s:bigint,c:bigint,u:bigint,d:date,l:bigint>"


def _cell(section: Column | str, key: Column, w=1, s=None, c=0, u=0, d=None, l=0) -> Column:
    sec = F.lit(section) if isinstance(section, str) else section
    return F.struct(sec.alias("section"), key.cast("string").alias("key"),
                    F.lit(w).cast("bigint").alias("w"),
                    (s if s is not None else F.lit(None)).cast("bigint").alias("s"),
                    (c if isinstance(c, Column) else F.lit(c)).cast("bigint").alias("c"),
                    (u if isinstance(u, Column) else F.lit(u)).cast("bigint").alias("u"),
                    (d if d is not None else F.lit(None)).cast("date").alias("d"),
                    (l if isinstance(l, Column) else F.lit(l)).cast("bigint").alias("l"))


def analytics_report(df: DataFrame, severity="severity", score="score", terms="technologies",
                     label="component", date="published_date",
                     links="additional_resources.externalLinks",
                     edges=SCORE_EDGES, labels=SCORE_LABELS, top_n: int = TOP_N) -> DataFrame:
    """Long table ``(section, key, n, value, text, rank)``; rank is 0 outside
    the ranked sections, and n of the date rows counts the dated records.

    Sections: total, severity (non-empty values), score_bucket (all labels,
    zeros included), average_score (value and 2-place text; 0 when no
    score; n of key ``unsummed`` counts the scores beyond it), top_technologies and top_components (top ``n`` by count, then
    key), with_links, date_range (earliest / latest). Any column argument
    may be ``None`` to leave its sections out (or a Column expression).
    """
    spark = df.sparkSession
    empty = F.array().cast(f"array<{_CELL}>")
    sc = _c(score).cast("double") if score is not None else F.lit(None).cast("double")
    scored = is_number(sc)
    has_links = (F.coalesce(F.size(_c(links)), F.lit(0)) > 0) if links is not None else F.lit(False)
    d = _c(date) if date is not None else F.lit(None)

    units = F.when(scored, score_units(sc))
    parts = [F.array(_cell(SEC_ALL, F.lit(""), 1, units, F.when(units.isNotNull(), 1).otherwise(0),
                           F.when(scored & units.isNull(), 1).otherwise(0), d, F.when(has_links, 1).otherwise(0)))]
    if severity is not None:
        sev = _c(severity)
        parts.append(F.when(_nonempty(sev), F.array(_cell(SEC_SEVERITY, sev))).otherwise(empty))
    if score is not None:
        parts.append(F.when(scored, F.array(_cell(SEC_BUCKET, bucket_of(sc, edges, labels)))).otherwise(empty))
    if terms is not None:
        parts.append(F.coalesce(F.transform(_c(terms), lambda t: _cell(SEC_TERMS, t)), empty))
    if label is not None:
        lab = _c(label)
        parts.append(F.when(_nonempty(lab), F.array(_cell(SEC_LABELS, lab))).otherwise(empty))

    cells = df.select(F.explode(F.concat(*parts)).alias("x")).select("x.*")
    # Rows that exist whatever the data: the overall row and every bucket.
    seed_rows = [(SEC_ALL, "")] + ([(SEC_BUCKET, lab) for lab in labels] if score is not None else [])
    seeds = (spark.range(1)
             .select(F.inline(F.array(*[_cell(sec, F.lit(k), 0) for sec, k in seed_rows]))))

    agg = (cells.unionByName(seeds)
           .groupBy("section", "key")
           .agg(F.sum("w").alias("n"), F.sum(F.col("s").cast(UNITS_TYPE)).alias("s"),
                F.sum("c").alias("c"), F.sum("u").alias("u"),
                F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.count("d").alias("dn"),
                F.sum("l").alias("l")))

    # One window for all sections: ranked sections form one window partition
    # each, every other (section, key) cell is alone in its partition (rank 1).
    # A uniform ``rank <= n`` filter lets WindowGroupLimit keep n rows per
    # section in each task before the exchange, and the aggregate is
    # computed once (no second scan for the ranked branch).
    ranked_secs = [SEC_TERMS, SEC_LABELS]
    is_ranked = F.col("section").isin(*ranked_secs)
    part = F.when(is_ranked, F.col("section")).otherwise(F.concat_ws("\u0000", "section", "key"))
    w = Window.partitionBy(part).orderBy(F.col("n").desc(), F.col("key").asc())
    kept = (agg.withColumn("rank", F.row_number().over(w))
               .filter(F.col("rank") <= top_n)
               .withColumn("rank", F.when(is_ranked, F.col("rank")).otherwise(F.lit(0))))

    value, text = _mean_columns("s", "c")
    null_d, null_s, null_n = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    row_t = "struct<section:string,key:string,n:bigint,value:double,text:string>"
    def row(section, key, n, v, t):
        return F.struct(section.alias("section"), key.alias("key"), n.alias("n"),
                        v.alias("value"), t.alias("text"))

    L = F.lit
    overall = F.array(
        row(L(SEC_TOTAL), L(""), F.col("n"), null_d, null_s),
        row(L(SEC_AVERAGE), L(""), F.col("c"), value, text),
        row(L(SEC_AVERAGE), L(UNSUMMED), F.col("u"), null_d, null_s),
        row(L(SEC_LINKS), L(""), F.col("l"), null_d, null_s),
        row(L(SEC_DATES), L("earliest"), F.col("dn"), null_d, F.col("d_min").cast("string")),
        row(L(SEC_DATES), L("latest"), F.col("dn"), null_d, F.col("d_max").cast("string")),
    ).cast(f"array<{row_t}>")
    plain = F.array(row(F.col("section"), F.col("key"), F.col("n"), null_d, null_s)).cast(f"array<{row_t}>")
    return (kept.select(F.explode(F.when(F.col("section") == SEC_ALL, overall).otherwise(plain)).alias("r"),
                        "rank")
                .select("r.*", "rank"))


# ---- single-measure jobs ---------------------------------------------------

def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def severity_distribution(df: DataFrame, severity="severity") -> DataFrame:
    """(severity, n) for non-empty values."""
    sev = _c(severity)
    return (df.filter(_nonempty(sev)).groupBy(sev.alias("severity"))
              .agg(F.count(F.lit(1)).alias("n")))


def score_histogram(df: DataFrame, score="score", edges=SCORE_EDGES, labels=SCORE_LABELS) -> DataFrame:
    """(bucket, n) with every bucket present, zeros included; one pass of
    conditional sums, then a tiny unpivot of the single result row."""
    sc = _c(score).cast("double")
    b = bucket_of(sc, edges, labels)
    sums = [F.count_if(is_number(sc) & (b == F.lit(lab))).alias(f"_b{i}") for i, lab in enumerate(labels)]
    one = df.agg(*sums)
    cells = F.array(*[F.struct(F.lit(lab).alias("bucket"), F.col(f"_b{i}").alias("n"))
                      for i, lab in enumerate(labels)])
    return one.select(F.explode(cells).alias("x")).select("x.bucket", "x.n")


def average_score(df: DataFrame, score="score", places: int = AVERAGE_PLACES) -> DataFrame:
    """(n_scored, avg_score, avg_text, n_unsummed): exact mean, rounded half-up, of the
    scores that a bigint of 1e-4 units holds; ``n_unsummed`` counts the others (infinities,
    |x| > 9.2e14). NULL and NaN are no scores."""
    sc = _c(score).cast("double")
    ok = is_number(sc)
    units = F.when(ok, score_units(sc))
    one = df.agg(F.sum(units.cast(UNITS_TYPE)).alias("s"), F.count_if(units.isNotNull()).alias("n_scored"),
                 F.count_if(ok & units.isNull()).alias("n_unsummed"))
    value, text = _mean_columns("s", "n_scored", places)
    return one.select("n_scored", value.alias("avg_score"), text.alias("avg_text"), "n_unsummed")


def top_terms(df: DataFrame, terms="technologies", n: int = TOP_N) -> DataFrame:
    """Top ``n`` array elements by count (each occurrence counts), ties by term."""
    counted = (df.select(F.explode(_c(terms)).alias("term"))
                 .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    w = Window.orderBy(F.col("n").desc(), F.col("term").asc())
    return counted.orderBy(F.col("n").desc(), F.col("term").asc()).limit(n).withColumn(
        "rank", F.row_number().over(w))


def top_labels(df: DataFrame, label="component", n: int = TOP_N) -> DataFrame:
    """Top ``n`` non-empty labels by count, ties by label."""
    lab = _c(label)
    counted = df.filter(_nonempty(lab)).groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col("label").asc())
    return counted.orderBy(F.col("n").desc(), F.col("label").asc()).limit(n).withColumn(
        "rank", F.row_number().over(w))


def date_range(df: DataFrame, date="published_date") -> DataFrame:
    d = _c(date)
    return df.agg(F.min(d).alias("earliest"), F.max(d).alias("latest"))


def with_links_count(df: DataFrame, links="additional_resources.externalLinks") -> DataFrame:
    has = F.coalesce(F.size(_c(links)), F.lit(0)) > 0
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_links"))


def facet_counts(df: DataFrame, facets: dict, top: int = FACET_TOP) -> DataFrame:
    """(facet, value, n, rank): value counts per facet, top ``top`` per facet.

    ``facets`` maps a facet name to a scalar or array Column. One explode
    unpivots all facets (no Expand of the wide row), partial aggregation
    runs before the shuffle, and WindowGroupLimit prunes per task.
    """
    cells = []
    for name, col in facets.items():
        c = _c(col)
        dtype = df.select(c.alias("_x")).schema["_x"].dataType
        if isinstance(dtype, T.ArrayType):
            def tag(nm):
                return lambda v: F.struct(F.lit(nm).alias("facet"), v.cast("string").alias("value"))
            cells.append(F.coalesce(F.transform(c, tag(name)),
                                    F.array().cast("array<struct<facet:string,value:string>>")))
        else:
            cells.append(F.when(c.isNotNull(), F.array(F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value"))))
                          .otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
    counted = (df.select(F.explode(F.concat(*cells)).alias("x")).select("x.*")
                 .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("facet").orderBy(F.col("n").desc(), F.col("value").asc())
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def inline_records(bodies: DataFrame, text: str, record: str) -> tuple[DataFrame, DataFrame]:
    """Records given inline, as JSON texts instead of a store: (records,
    rejected texts with a reason). Each text must be an array of records of
    the schema ``record``; an empty array has none, NULL is no array."""
    t = F.ltrim(F.col(text))
    parsed = bodies.select(text, F.from_json(t, f"array<{record}>").alias("_records"),
                           F.coalesce(t.startswith("["), F.lit(False)).alias("_array"))
    reason = F.when(~F.col("_array"), "not_an_array").when(F.col("_records").isNull(), "bad_json")
    parsed = parsed.select(text, "_records", reason.alias("reason"))
    return (parsed.filter("reason IS NULL").select(F.inline("_records")),
            parsed.filter("reason IS NOT NULL").select(text, "reason"))


def load_summary(df: DataFrame, key: str = "cve_id", accepted: Column | None = None) -> DataFrame:
    """(total, accepted, rejected, distinct_keys) of one load."""
    acc = accepted if accepted is not None else F.lit(True)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(acc).alias("accepted"),
                  F.count_if(~acc).alias("rejected"),
                  F.count_distinct(F.col(key)).alias("distinct_keys"))


def observed_load(df: DataFrame, accepted: Column) -> tuple[DataFrame, Observation]:
    """``df`` with the load's counts collected as a side of whatever action reads it
    first: no scan of their own. ``observed_summary`` shows them afterwards."""
    counts = Observation()
    return df.observe(counts, F.count(F.lit(1)).alias("total"), F.count_if(accepted).alias("accepted"),
                      F.count_if(~accepted).alias("rejected")), counts


def observed_summary(spark: SparkSession, counts: Observation) -> DataFrame:
    """(total, accepted, rejected), once the observed frame was read."""
    return spark.range(1).select(*[F.lit(counts.get[c]).cast("bigint").alias(c) for c in ("total", "accepted", "rejected")])


def slice_load_report(df: DataFrame, slice_col: str = "slice", key: str = "cve_id",
                      accepted: Column | None = None, warn_rate: float = 0.5,
                      bad_page: Column | None = None) -> DataFrame:
    """Per slice (with ``bad_page`` its rows count as ``bad_pages``, not as hits): rows, accepted, rejected, distinct keys; a slice with no
    accepted row counts as failed. Adds the overall failure rate and flags
    (warn above ``warn_rate``, error when nothing was accepted at all)."""
    acc = accepted if accepted is not None else F.lit(True)
    hit = F.lit(True) if bad_page is None else ~bad_page
    pages = [] if bad_page is None else [F.count_if(bad_page).alias("bad_pages")]
    per = df.groupBy(slice_col).agg(
        F.count_if(hit).alias("rows"), F.count_if(acc & hit).alias("accepted"),
        F.count_if(~acc & hit).alias("rejected"), *pages,
        F.count_distinct(F.when(acc, F.col(key))).alias("distinct_keys"))
    w = Window.partitionBy()
    failed = (F.col("accepted") == 0).cast("int")
    out = per.withColumn("failed", F.col("accepted") == 0)
    n_sl = F.count(F.lit(1)).over(w)
    n_failed = F.sum(failed).over(w)
    rate = n_failed / n_sl
    return (out.withColumn("failure_rate", F.round(rate, 6))
               .withColumn("warn", rate > F.lit(warn_rate))
               .withColumn("error", F.sum(F.col("accepted")).over(w) == 0))
