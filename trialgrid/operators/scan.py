"""Scans of text for denied n-grams, patterns and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S

#: Entries of a denylist (about 100 bytes each) that a task may hold.
BROADCAST_ROWS = 500_000


def text_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line_no", "value"))


def build_denylist(phrases: DataFrame, column: str, n: int, salt: str) -> DataFrame:
    """n, digest of the n-grams of phrases."""
    grams = phrases.select(F.explode(S.ngrams(S.words(F.col(column)), n)).alias("g")).distinct()
    return grams.select(F.lit(n).alias("n"), S.salted_digest(salt, F.col("g")).alias("digest"))


def scan_ngrams(lines: DataFrame, denylist: DataFrame, salt: str, sizes: tuple[int, ...], key: str) -> DataFrame:
    """key, line_no, n, hits of lines that hold denied n-grams. Text is not shown.

    n-grams are hashed where they are read and only those on the list leave the scan: a list of at most `BROADCAST_ROWS`
    entries is counted and sent to the tasks; a longer one is joined by digest."""
    tokens = lines.withColumn("_w", S.words(F.col("value")))
    lists = F.array(*[F.struct(F.lit(n).alias("n"), S.ngrams(F.col("_w"), n).alias("grams")) for n in sizes])
    every = tokens.where(F.size("_w") >= min(sizes)).select(key, "line_no", F.explode(lists).alias("_l")).select(key, "line_no", "_l.n", F.explode("_l.grams").alias("_g"))
    every = every.select(key, "line_no", "n", S.salted_digest(salt, F.col("_g")).alias("digest"))
    short = denylist.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return every.join(F.broadcast(denylist) if short else denylist, ["n", "digest"], "left_semi").groupBy(key, "line_no", "n").agg(F.count("*").alias("hits"))


def check_denylist(denylist: DataFrame, stated: int, canary: str, salt: str) -> DataFrame:
    """n_entries, count_ok, canary_ok: the list is whole and the scanner finds its own token."""
    own = S.salted_digest(salt, F.lit(canary))
    return denylist.agg(F.count("*").alias("n_entries"), F.bool_or(F.col("digest") == own).alias("canary_ok")).withColumn("count_ok", F.col("n_entries") == stated)


def scan_patterns(lines: DataFrame, patterns: list[tuple[str, str]], allow: list[str] | None = None, path: str | None = None, show: int = 160) -> DataFrame:
    """lines with a reason for each pattern they match, and their first characters."""
    if allow and path:
        lines = lines.where(~F.col(path).isin(*allow))
    reasons = F.filter(F.array(*[F.when(F.col("value").rlike(p), reason) for p, reason in patterns]), lambda r: r.isNotNull())
    return lines.select("*", F.explode(reasons).alias("reason")).withColumn("value", F.substring(F.trim("value"), 1, show))


def scan_tokens(files: DataFrame, tokens: list[str], key: str, content: str, exempt: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """key, place, token: the first denied token that a file's content holds, in upper or lower case, and the first that its path does.

    Exempt files are read by their paths only. One pass."""

    def first(text: str):
        low = F.lower(F.col(text))
        return F.coalesce(*[F.when(low.contains(t.lower()), F.lit(t)) for t in tokens])

    places = [F.struct(F.lit("content").alias("place"), first(content).alias("token"))]
    if path:
        places.append(F.struct(F.lit("path").alias("place"), first(path).alias("token")))
    hits = files.select(key, F.explode(F.filter(F.array(*places), lambda h: h["token"].isNotNull())).alias("h")).select(key, "h.place", "h.token")
    if exempt is None:
        return hits
    free = exempt.select(F.col(key).alias("_free")).distinct().withColumn("_exempt", F.lit(True))
    return hits.join(free, F.col(key) == F.col("_free"), "left").where(F.col("_exempt").isNull() | (F.col("place") == "path")).drop("_free", "_exempt")
