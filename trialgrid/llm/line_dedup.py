"""Removal of recurring lines by a fixed-depth template tree (native: DataFrame functions only).

A line's leaf is found by its number of tokens and its first DEPTH tokens; tokens that hold a digit stand as '<*>', but for
lines that would be '<*>' for the most part, which stand as they are. Leaves that fewer than MIN_DOCS documents share hold no
recurring template and go at once, on hashes alone.

A leaf may hold any number of templates. A token at a place is a template's word if MIN_DOCS documents or more have it there
and they are at least a given share of the leaf's: a half, an eighth, a thirty-second, or any (SHARES). What a line looks like
at each of these levels, its other tokens as '<*>', is a template that it may belong to, so that at the coarse levels fields
with few values vary as well, and at the finest unlike kinds of lines don't mix. A template counts only if its words make up
SIMILARITY of the places without digits, half of all places, and half of those after the leading ones, which all lines of a
leaf share anyway. Lines of at most DEPTH tokens are templates as they stand. A template found in MIN_DOCS documents or more
is dropped from all documents but the one of the smallest id (which keeps what it says once for all).

All gathering is in counts per leaf, place and token, and in sums of hashes per line, each in partial aggregates; no leaf is
gathered in one task. A document's dropped line numbers are gathered per document only.

Defined results: null text has no lines and stays null; blank lines are kept; what fewer than MIN_DOCS documents share stays;
rows with equal ids count as one document; a null id counts as one document as well, after all others; further columns pass
through untouched; an empty table gives an empty result. White space between tokens is no part of a template. Templates are
told apart by 64-bit hashes within their leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, read_table, release, with_and_without

MIN_DOCS, DEPTH, SIMILARITY = 3, 3, 0.6
#: A template's word is held by at least one in so many of its leaf's documents; None: MIN_DOCS are enough.
SHARES = (2, 8, 32, None)
BROADCAST_ROWS = 1_000_000
_MASK = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _times(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _exploded(docs: DataFrame) -> DataFrame:
    """doc, line_no, leaf, line_key, shape (the line with single blanks and masked tokens), size of all lines that aren't blank."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(_lines(F.col("text"))).alias("line_no", "line")).where(F.col("line").rlike("[^ \t\r]"))
    odd = F.col("line").rlike("[0-9\t\r]") | F.contains("line", F.lit("  "))  # few lines are, and only these need expressions that are slow
    plain = F.when(odd, F.trim(F.regexp_replace(F.translate("line", "\t\r", "  "), " {2,}", " "))).otherwise(F.trim("line"))
    lines = lines.select("doc", "line_no", odd.alias("odd"), plain.alias("line"))
    lines = lines.withColumn("masked", F.when(F.col("odd"), F.regexp_replace("line", _MASK, "<*>")).otherwise(F.col("line"))).withColumn("size", _times(F.col("line"), " ") + 1)
    mostly = F.contains("masked", F.lit("<*>")) & (2 * _times(F.col("masked"), "<*>") > F.col("size"))
    lines = lines.withColumn("shape", F.when(mostly, F.col("line")).otherwise(F.col("masked")))
    leaf = F.xxhash64("size", F.substring_index("shape", " ", DEPTH))
    return lines.select("doc", "line_no", leaf.alias("leaf"), F.xxhash64("shape").alias("line_key"), "shape", "size")


def _templates(different: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(leaf, line_key, template: the templates that each different line (leaf, line_key, shape, size, weight) belongs to; tables that this reads)."""
    short = different.where(F.col("size") <= DEPTH).select("leaf", "line_key", F.lit(0).cast("long").alias("template"))
    tokens = different.where(F.col("size") > DEPTH).withColumn("tokens", F.split("shape", " "))
    places = tokens.select("leaf", "line_key", "weight", F.posexplode(F.slice("tokens", DEPTH + 1, F.size("tokens"))).alias("place", "token"))
    # counts are written, so that the joins read two plain shuffles, whose hot keys Spark can split
    votes = materialize(places.groupBy("leaf", "place", "token").agg(F.sum("weight").alias("votes")).where(F.col("votes") >= MIN_DOCS), "votes")
    totals = materialize(different.groupBy("leaf").agg(F.sum("weight").alias("total")), "totals")
    lead = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda t: t != "<*>"))
    told = tokens.select("leaf", "line_key", "size", lead.alias("lead")).join(totals, "leaf")

    star = F.col("token") == "<*>"
    held = [F.lit(True) if k is None else k * F.col("votes") >= F.col("total") for k in SHARES]
    word = [F.coalesce(F.col("votes").isNotNull() & h & ~star, F.lit(False)) for h in held]
    sums = [F.sum(star.cast("int")).alias("stars")]
    for i, w in enumerate(word):
        sums.append(F.bit_xor(F.xxhash64("place", F.when(w, F.col("token")).otherwise(F.lit("<*>")))).alias(f"template{i}"))
        sums.append(F.sum(w.cast("int")).alias(f"words{i}"))
    seen = places.drop("weight").join(votes, ["leaf", "place", "token"], "left").join(told, ["leaf", "line_key"])
    lines = seen.groupBy("leaf", "line_key").agg(F.first("size").alias("size"), F.first("lead").alias("lead"), *sums)

    def counts(i: int) -> Column:
        words, plain = F.col(f"words{i}") + F.col("lead"), F.col("size") - F.col("stars") - (DEPTH - F.col("lead"))
        rest = F.col("size") - DEPTH - F.col("stars")
        return (words >= SIMILARITY * plain) & (2 * words >= F.col("size")) & (2 * F.col(f"words{i}") >= rest)

    levels = F.array_distinct(F.array_compact(F.array(*(F.when(counts(i), F.col(f"template{i}")) for i in range(len(SHARES))))))
    return short.unionByName(lines.select("leaf", "line_key", F.explode(levels).alias("template"))), [votes, totals]


def recurring_lines(docs: DataFrame) -> DataFrame:
    """doc, line_no of the lines to drop, a written table."""
    lines = _exploded(docs)
    holders = lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    leaves = materialize(holders.select("leaf"), "leaves")
    few = leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    candidates = materialize(lines.join(F.broadcast(leaves) if few else leaves, "leaf"), "lines")
    release(leaves)
    # each different line of a leaf once, with the number of documents that have it
    held = candidates.groupBy("leaf", "line_key", "doc").agg(F.first("size").alias("size"), F.min("line_no").alias("line_no"))
    weights = held.groupBy("leaf", "line_key").agg(F.count("*").alias("weight"), F.first("size").alias("size"))
    shapes = candidates.select("leaf", "line_key", "shape").dropDuplicates(["leaf", "line_key"])
    different = materialize(weights.join(shapes, ["leaf", "line_key"]), "different")
    templates, counts = _templates(different)
    members = candidates.select("doc", "line_no", "leaf", "line_key").join(templates, ["leaf", "line_key"])
    members = materialize(members.select("doc", "line_no", "leaf", "template"), "members")
    release(candidates, different, *counts)
    spread = members.select("leaf", "template", "doc").distinct().groupBy("leaf", "template").agg(F.count("*").alias("n"), F.min("doc").alias("keeper"))
    spread = materialize(spread.where(F.col("n") >= MIN_DOCS), "spread")
    kept = members.join(spread, ["leaf", "template"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    gone = materialize(kept.select("doc", "line_no"), "gone")
    release(members, spread)
    return gone


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", left: list[DataFrame] | None = None) -> DataFrame:
    """df with the text's recurring lines taken out, and the columns _n_lines and _n_dropped; left: gets the tables to release once the result is written."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone_lines = recurring_lines(docs)
    if left is not None:
        left.append(gone_lines)
    drop = gone_lines.groupBy("doc").agg(F.collect_set("line_no").alias("__gone_lines")).withColumnRenamed("doc", "__gone_doc")  # of one document
    some, whole = with_and_without(df, F.xxhash64(id_col), gone_lines.select(F.xxhash64("doc").alias("k")))
    # both sides grow with the table, so they are never a broadcast; texts that lose nothing are not sent
    joined = some.join(drop.hint("merge"), F.col(id_col).eqNullSafe(F.col("__gone_doc")), "left").drop("__gone_doc")
    none = F.array().cast("array<int>")
    joined = joined.unionByName(whole.withColumn("__gone_lines", F.lit(None).cast("array<int>")))
    lines = _lines(F.col(text_col).cast("string"))
    gone = F.coalesce(F.col("__gone_lines"), none)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(gone, i))
    text = F.when(F.col("__gone_lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({"_n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "_n_dropped": F.size(gone).cast("long"), text_col: text}).drop("__gone_lines")


def op6_log_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.greatest("_n_lines", F.lit(0)).alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_sql(source: str = "documents", select: str | None = None) -> str:
    words = [f"votes >= {MIN_DOCS} AND token <> '<*>'" + (f" AND {k} * votes >= total" if k else "") for k in SHARES]
    levels = "UNION\n".join(f"""
  SELECT leaf, line_key, string_agg(CASE WHEN {w} THEN token ELSE '<*>' END, ' ' ORDER BY place) AS template
  FROM dd_seen GROUP BY leaf, line_key, size, lead
  HAVING count(*) FILTER (WHERE {w}) + lead >= {SIMILARITY} * (size - count(*) FILTER (WHERE token = '<*>') - ({DEPTH} - lead))
     AND 2 * (count(*) FILTER (WHERE {w}) + lead) >= size
     AND 2 * count(*) FILTER (WHERE {w}) >= size - {DEPTH} - count(*) FILTER (WHERE token = '<*>')
""" for w in words)  # fmt: skip
    return f"""
WITH dd_raw AS (SELECT doc_id AS doc, text, string_split(text, chr(10)) AS ls FROM {source}),
dd_lines AS (
  SELECT doc, line_no, list_filter(string_split(translate(line, chr(9) || chr(13), '  '), ' '), lambda t: t <> '') AS plain
  FROM (SELECT doc, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM dd_raw)),
dd_masked AS (SELECT *, list_transform(plain, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS masked FROM dd_lines WHERE len(plain) > 0),
dd_tok AS (
  SELECT doc, line_no, len(plain) AS size,
         CASE WHEN 2 * (length(array_to_string(masked, ' ')) - length(replace(array_to_string(masked, ' '), '<*>', ''))) / 3 > len(plain) THEN plain ELSE masked END AS tokens
  FROM dd_masked),
dd_leaf AS (SELECT *, CAST(size AS VARCHAR) || ' ' || array_to_string(tokens[1:{DEPTH}], ' ') AS leaf, array_to_string(tokens, ' ') AS line_key FROM dd_tok),
dd_leaves AS (SELECT leaf FROM dd_leaf GROUP BY leaf HAVING count(DISTINCT doc) >= {MIN_DOCS}),
dd_cand AS (SELECT * FROM dd_leaf WHERE leaf IN (SELECT leaf FROM dd_leaves)),
dd_diff AS (SELECT leaf, line_key, any_value(tokens) AS tokens, any_value(size) AS size, count(DISTINCT doc) AS weight FROM dd_cand GROUP BY leaf, line_key),
dd_total AS (SELECT leaf, sum(weight) AS total FROM dd_diff GROUP BY leaf),
dd_places AS (
  SELECT leaf, line_key, size, weight, len(list_filter(tokens[1:{DEPTH}], lambda t: t <> '<*>')) AS lead,
         unnest(range({DEPTH + 1}, size + 1)) AS place, unnest(tokens[{DEPTH + 1}:]) AS token
  FROM dd_diff WHERE size > {DEPTH}),
dd_votes AS (SELECT leaf, place, token, sum(weight) AS votes FROM dd_places GROUP BY leaf, place, token),
dd_seen AS (SELECT p.*, votes, total FROM dd_places p JOIN dd_votes v USING (leaf, place, token) JOIN dd_total t USING (leaf)),
dd_member AS (SELECT leaf, line_key, '' AS template FROM dd_diff WHERE size <= {DEPTH} UNION {levels}),
dd_match AS (SELECT DISTINCT doc, line_no, leaf, template FROM dd_cand JOIN dd_member USING (leaf, line_key)),
dd_spread AS (SELECT leaf, template, min(doc) AS keeper FROM dd_match GROUP BY leaf, template HAVING count(DISTINCT doc) >= {MIN_DOCS}),
dd_drop AS (SELECT doc, list(DISTINCT line_no) AS gone FROM dd_match JOIN dd_spread USING (leaf, template) WHERE doc <> keeper GROUP BY doc),
dd_kept AS (
  SELECT r.doc AS doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
         CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[CAST(i + 1 AS BIGINT)]), chr(10)) END AS text
  FROM dd_raw r LEFT JOIN dd_drop d ON r.doc = d.doc)
""" + (select or "SELECT doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM dd_kept")
