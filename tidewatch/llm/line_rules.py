"""Operator 10: quality rules and cross-document line frequency, in DataFrame functions only.

Lines are normalised (white space collapsed, A-Z lowered, digits to 0) and hashed. A line is repeated on a host if the host's
distinct documents that hold it number more than ``max_docs`` and more than ``max_share`` of the host's distinct documents. On
a host of up to 10,000 the first limit decides; above, the share does, since phrases that recur by chance grow in number with
the host while a template's share doesn't shrink. Documents
are told apart by the set of all their normalised lines, so copies count once, however many there are, and two documents with
the same template and different content count twice. Texts that differ in a word are different documents. A document
is rejected when less than ``min_left`` of its words are left without its repeated lines; ``keep_good`` takes these lines out
of the texts that it keeps. The base rules judge the text as it came.

Lines are parsed and hashed once, into a table in the shared folder. A host or a line may hold any share of the rows: counting is
pre-aggregated by task, repeated lines are broadcast where they are few, and where they are many, those on more than
``HEAVY`` rows are (which are at most one in ``HEAVY`` of all lines), so that the rest can be joined by key.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows (same id and
text) get the same result each; ids that differ only in text are told apart; an empty table gives no rows; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPLIT, read, stash

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_DOCS = 10
MAX_SHARE = 0.001
MIN_LEFT = 0.5
BROADCAST_ROWS = 1 << 18  # a host's name and 16 bytes each
HEAVY = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz0000000000"


def _normal(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, WORD_SPLIT, " ")), _UPPER, _LOWER)


def text_counts(docs: DataFrame) -> DataFrame:
    """The counts of the base rules for each row of ``docs`` (doc_id, text), with the text's md5 as ``text_key``."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.select("doc_id", "t", F.array_remove(F.split("t", WORD_SPLIT), "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id",
        F.md5("t").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).alias("w"),
    )
    # windows ordered by hash, then place: the same window stands next to itself, in n log n steps however often it recurs
    some = F.size("w") > F.size(F.array_distinct("w"))
    d = d.withColumn("s", F.when(some, F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("w")
    d = d.withColumn("p", F.sort_array(F.filter(F.transform("s", lambda x, k: F.when((x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]), x["i"])), lambda x: x.isNotNull()))).drop("s")
    reach = F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("p")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, host and the document's normalised lines: hash ``h``, words ``w``, place ``at`` among all its lines."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("host", F.lit("")).alias("host"))
    norm = F.transform(F.split("t", "\n"), lambda x, i: F.struct(_normal(x).alias("x"), i.alias("at")))
    d = d.select("doc_id", F.md5("t").alias("text_key"), "host", F.filter(norm, lambda s: s["x"] != "").alias("l"))
    d = d.withColumn("l", F.transform("l", lambda s: F.struct(F.unhex(F.md5(s["x"])).alias("h"), F.size(F.split(s["x"], " ")).alias("w"), s["at"].alias("at"))))
    return stash(d, "lines")


def repeated_lines(lines: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h, held): the lines that recur on a host beyond the limits, and how many rows hold them. ``lines``: as parsed."""
    none = F.lit(b"")
    d = lines.select("host", F.sort_array(F.array_distinct(F.transform("l", lambda x: x["h"]))).alias("hs"))
    # the empty hash stands for the document itself, so that a host's distinct documents are counted in the same pass
    whole = F.unhex(F.md5(F.array_join(F.transform("hs", F.hex), "").cast("binary")))
    d = d.select("host", whole.alias("whole"), F.explode(F.concat(F.array(none), "hs")).alias("h"))
    each = d.groupBy("host", "h", "whole").agg(F.count(F.lit(1)).alias("held"))  # in two steps, so that a hot line is counted by many tasks
    counts = each.groupBy("host", "h").agg(F.count("held").alias("kinds"), F.sum("held").alias("held")).where((F.col("h") == none) | (F.col("kinds") > max_docs))
    counts = stash(counts, "line-counts")  # read twice; it holds the hosts and the few lines that recur
    hosts = counts.where(F.col("h") == none).select("host", F.col("kinds").alias("of"))
    return counts.where(F.col("h") != none).join(hosts, "host").where(F.col("kinds") > max_share * F.col("of")).select("host", "h", "held")


def removed_lines(lines: DataFrame, repeated: DataFrame, broadcast_rows: int = BROADCAST_ROWS, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, text_key, removed, places): the words in repeated lines and these lines' places, for documents that have any."""
    d = lines.select("doc_id", "text_key", "host", F.explode("l").alias("l"))
    d = d.select("doc_id", "text_key", "host", F.col("l.at").alias("at"), F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    repeated = stash(repeated, "repeated")
    if repeated.count() <= broadcast_rows:
        met = d.join(F.broadcast(repeated.drop("held")), ["host", "h"])
    else:
        many, few = repeated.where(F.col("held") > heavy), repeated.where(F.col("held") <= heavy)
        many = many.drop("held").hint("broadcast") if many.count() <= broadcast_rows else many.drop("held")
        met = d.join(many, ["host", "h"]).unionByName(d.join(few.drop("held"), ["host", "h"]))
    once = met.groupBy("doc_id", "text_key", "at").agg(F.max("w").alias("w"))  # equal rows count once
    return once.groupBy("doc_id", "text_key").agg(F.sum("w").cast("long").alias("removed"), F.sort_array(F.collect_list("at")).alias("places"))


def _judged(docs: DataFrame, host: str, max_docs: int, max_share: float, min_left: float) -> DataFrame:
    """Counts, verdict and the ``places`` of repeated lines (null if none) for every row of ``docs``."""
    own = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"))
    lines = parsed_lines(own)
    removed = removed_lines(lines, repeated_lines(lines, max_docs, max_share)).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    d = text_counts(own)
    d = d.join(removed, d["doc_id"].eqNullSafe(removed["_id"]) & (d["text_key"] == removed["_key"]), "left")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    d = d.withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    return d.withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words"))).drop("_id", "_key", "removed")


def quality_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text and the host column)."""
    return _judged(docs, host, max_docs, max_share, min_left).drop("places")


def _without(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``row.*`` of ``rows`` (row, places) with the lines at ``places`` taken out of its text."""
    # lines is read twice below, so that it is split once a row and not again for every line
    d = rows.withColumn("lines", F.when(F.col("places").isNotNull(), F.split(F.col("row")["text"], "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    cut = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    d = d.withColumn("cut", F.when(F.col("places").isNotNull(), cut).otherwise(F.col("row")["text"]))
    return d.select(*[F.col("cut").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns])


def keep_good(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their repeated lines removed from ``text``; other columns are as they were.

    The verdicts are written to the shared folder first: a filter on them must not reach into the expressions that
    count words, which would then be evaluated again for every element.
    """
    verdicts = stash(_judged(docs, host, max_docs, max_share, min_left).select("doc_id", "text_key", "kept", "places"), "verdicts")
    noted = verdicts.where(~F.col("kept") | F.col("places").isNotNull()).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}).dropDuplicates(["_id", "_key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    good = rows.join(noted, rows["row"]["doc_id"].eqNullSafe(noted["_id"]) & (rows["key"] == noted["_key"]), "left").where(F.coalesce("kept", F.lit(True)))
    return _without(good.select("row", "places"), docs.columns)


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).drop("text_key")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, md5(coalesce(text, '')) AS k FROM documents),
tok AS (SELECT doc_id, k, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, k, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT DISTINCT doc_id, k, w FROM tok WHERE len(w) >= 3))),
dup AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, k, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS nxt FROM dup) GROUP BY ALL),
base AS (
  SELECT tok.doc_id, tok.k, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM tok LEFT JOIN rep ON tok.doc_id IS NOT DISTINCT FROM rep.doc_id AND tok.k = rep.k),
ln AS (SELECT doc_id, k, host, nr, x FROM (SELECT doc_id, k, host, unnest(xs) AS x, unnest(range(len(xs))) AS nr FROM (
  SELECT doc_id, k, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), '{_UPPER}', '{_LOWER}')), lambda x: x <> '') AS xs FROM d))),
whole AS (SELECT doc_id, k, host, md5(coalesce(string_agg(x, chr(10) ORDER BY x), '')) AS whole FROM (SELECT DISTINCT d.doc_id, d.k, d.host, x FROM d LEFT JOIN ln ON ln.doc_id IS NOT DISTINCT FROM d.doc_id AND ln.k = d.k) GROUP BY ALL),
hot AS (SELECT host, x FROM (SELECT ln.host, x, count(DISTINCT whole) AS kinds FROM ln JOIN whole ON whole.doc_id IS NOT DISTINCT FROM ln.doc_id AND whole.k = ln.k AND whole.host = ln.host GROUP BY ln.host, x)
  JOIN (SELECT host, count(DISTINCT whole) AS n FROM whole GROUP BY host) USING (host) WHERE kinds > {MAX_DOCS} AND kinds > {MAX_SHARE} * n),
gone AS (SELECT doc_id, k, sum(len(string_split(x, ' '))) AS n FROM (SELECT DISTINCT doc_id, k, nr, x FROM ln JOIN hot USING (host, x)) GROUP BY ALL)
SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(gone.n, 0) >= {MIN_LEFT} * n_words AS kept
FROM base LEFT JOIN gone ON gone.doc_id = base.doc_id AND gone.k = base.k
"""
