"""Quality rules: cross-document line frequency (DataFrame functions only).

Lines are normalised (lower case, white space collapsed) and hashed. Per host
the number of distinct documents that hold a line is counted; lines above the
limits are boilerplate and are removed; a document of which too little is left
is depleted and rejected. Documents are the same if all their normalised lines are,
in order: copies of a document, with other white space or case too, count
once, and a group of copies of any size does not turn its own text into
boilerplate. Copies with edits are documents of their own.

Every text is split and hashed once, and the rows (host, line hash, document hash, position) are
cut; shuffles carry hashes, never texts. (host, line, document) is made
distinct by its full key before any count per line, so a line that a third of all
rows share is spread over all tasks, and the second count is pre-aggregated.
The join that marks lines meets unique keys on its small side, so AQE can
split a hot line on the other; (host, text) has as many rows as the text has lines.

Defined cases: a NULL text is an empty one (no words, fails the base rule);
NULL host is a host of its own; repeated rows get equal results; an empty
table gives an empty result; columns of the input that clash with an added
name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import SPACE_RUN, cut, null_key, without

WINDOW = 8
#: Characters counted as symbols (fixed value).
SYMBOL = r"[#*$%&|<>]"
NON_SPACE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate on more than ``min_docs`` distinct documents and
    more than ``share`` of its host's or ``enough_docs`` of them, whichever is
    less; a document is depleted when fewer than ``min_words`` words, or less
    than ``min_left`` of its words, are left."""

    min_docs: int = 10
    share: float = 0.02
    enough_docs: int = 100
    min_words: int = 20
    min_left: float = 0.3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def has_word(line: Column) -> Column:
    return line.rlike(NON_SPACE)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE_RUN, " "))


def text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed (see the module docstring for NULL and empty texts).

    Repeated windows: each 8-word window is hashed; only texts in which a hash
    occurs twice sort their (hash, position) pairs to find the positions, so
    the cost is n log n for any text length.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    keep = [c for c in without(df, *names) if c != text]
    t = F.col("rec")[text]
    out = df.select(F.struct("*").alias("rec"))
    out = out.select("rec", F.coalesce(t, F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), has_word)
    out = out.select("rec", words_of(F.col("t")).alias("w"), F.regexp_count("t", F.lit(SYMBOL)).alias("n_symbols"),
                     lines.alias("ls"))
    out = out.select("rec", "n_symbols", F.size("w").cast("long").alias("n_words"),
                     F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                     (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
                     F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    starts = F.slice("wh", 1, F.greatest(F.size("wh") - (WINDOW - 1), F.lit(0)))
    out = out.withColumn("h", F.transform(starts, lambda x, i: F.xxhash64(
        x, *[F.get("wh", i + k) for k in range(1, WINDOW)])))
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    out = out.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed)).drop("h", "wh")
    again = F.filter("s", lambda e, i: ((i > 0) & (F.get("s", i - 1)["h"] == e["h"]))
                     | F.coalesce(F.get("s", i + 1)["h"] == e["h"], F.lit(False)))
    out = out.withColumn("p", F.sort_array(F.transform(again, lambda e: e["p"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)),
                                                               F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.select(*[F.col("rec")[c].alias(c) for c in [text, *keep]], "n_words", "word_chars",
                      F.col("n_symbols").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"))


def _lines(df: DataFrame, key: list[str], text: str, host: str) -> DataFrame:
    """One row per non-blank line: key columns k0.., kt, host, doc (the hash of all lines), pos, h, w."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = df.select(*[null_key(F.col(c)).alias(f"k{i}") for i, c in enumerate(key)], F.xxhash64(text).alias("kt"),
                    null_key(F.col(host)).alias("host"),
                    F.filter(F.transform(split, lambda x, i: F.struct(i.alias("pos"), normal_line(x).alias("line"))),
                             lambda e: e["line"] != "").alias("ls"))
    out = out.withColumn("ls", F.transform("ls", lambda e: F.struct(
        F.xxhash64(e["line"]).alias("h"), e["pos"].alias("pos"), F.size(F.split(e["line"], " ")).alias("w"))))
    out = out.withColumn("doc", F.xxhash64(F.transform("ls", lambda e: e["h"])))
    names = [*[f"k{i}" for i in range(len(key))], "kt", "host", "doc"]
    return out.select(*names, F.explode("ls").alias("e")).select(*names, "e.pos", "e.h", "e.w")


def _depleted(left: Column, words: Column, limits: LineLimits) -> Column:
    return (left < limits.min_words) | (left < words * F.lit(limits.min_left))


def frequent_lines(lines: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, h) of the lines above the limits."""
    per_line = (lines.select("host", "h", "doc").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
                .filter(F.col("n") > limits.min_docs))
    hosts = lines.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    bar = F.least(F.col("docs") * F.lit(limits.share), F.lit(float(limits.enough_docs)))
    return per_line.join(hosts, "host").filter(F.col("n") > bar).select("host", "h")


def removed_lines(df: DataFrame, key: list[str], text: str, host: str, limits: LineLimits) -> DataFrame:
    """Per document (k0.., kt) with boilerplate: ``removed``, the (pos, w) of its removed lines."""
    lines = cut(_lines(df, key, text, host))
    names = [*[f"k{i}" for i in range(len(key))], "kt"]
    hit = lines.select(*names, "host", "h", "pos", "w").join(frequent_lines(lines, limits), ["host", "h"])
    return hit.groupBy(*names, "host").agg(F.collect_set(F.struct("pos", "w")).alias("removed"))


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  limits: LineLimits = LineLimits()) -> DataFrame:
    """``df`` with the text measures, ``n_removed_words``, ``removed_lines``
    (0-based positions, NULL for none) and ``kept``. Rows are identified by
    (key, text hash, host), so repeated rows get equal results."""
    names = ("n_removed_words", "removed_lines", "kept")
    left = text_measures(df.select(*without(df, *names)), text)
    columns = left.columns
    left = left.withColumns({"__k0": null_key(F.col(key)), "__kt": F.xxhash64(text), "__host": null_key(F.col(host))})
    gone = removed_lines(df, [key], text, host, limits).select(
        F.col("k0").alias("__k0"), F.col("kt").alias("__kt"), F.col("host").alias("__host"),
        F.transform("removed", lambda e: e["pos"]).alias("removed_lines"),
        F.aggregate("removed", F.lit(0), lambda a, e: a + e["w"]).cast("long").alias("n_removed_words"))
    out = left.join(gone, ["__k0", "__kt", "__host"], "left")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    rest = F.col("n_words") - F.col("n_removed_words")
    depleted = _depleted(rest, F.col("n_words"), limits)
    # one CASE, not a conjunction: a filter on it is not pushed below the join, into copies of the measures
    kept = F.when(F.col("base_failed"), False).otherwise(~depleted)
    return out.select(*columns, "n_removed_words", "removed_lines", kept.alias("kept"))


def clean_documents(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                    limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept documents, boilerplate lines removed, with the columns of the
    input, whatever their names; ``n_chars`` (if there is one) is counted anew
    where lines went."""
    rest = F.struct(*[F.col(c) for c in df.columns if c != text]).alias("rest")
    slim = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(host).alias("host"), rest)
    judged = quality_rules(slim, "id", "text", "host", limits).filter("kept")
    lines = F.split(F.col("text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed_lines"))
    rebuilt = judged.withColumn("rebuilt", F.when(F.col("removed_lines").isNotNull(),
                                                  F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")))
    final = {c: F.col("rest")[c] for c in df.columns if c != text} | {text: F.coalesce("rebuilt", "text")}
    if "n_chars" in df.columns and text != "n_chars":
        final["n_chars"] = F.when(F.col("rebuilt").isNotNull(), F.length("rebuilt").cast(
            df.schema["n_chars"].dataType)).otherwise(final["n_chars"])
    return rebuilt.select(*[final[c].alias(c) for c in df.columns])
