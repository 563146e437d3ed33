"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A document is a sequence of lines; lines of white space alone are passed over.
In every window of RUN consecutive lines the line of least hash is selected, so
whatever repeats for RUN lines or more shares a selected line: selected lines
are guaranteed fingerprints. A line of WORDS words or more is a fingerprint of
its own. Fingerprints that occur at one place only are done with. The others
carry the digests of their neighbours: each is extended by them both ways, what
it extends to is held against the first place where the same lines stand, and
chains of such extensions make up the maximal later runs. Their lines are
deleted; first occurrences stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, scratch, sieve, sifted, written

RUN = 2
#: Words of a line that counts as a run by itself.
WORDS = 50
FILLED = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(text: Column) -> Column:
    """The first half of a SHA-256, as bytes."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _long(line: Column) -> Column:
    """Whether a line has WORDS words or more. Only lines of enough bytes are counted, and by their spaces unless they hold more than single ones."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    ends = F.startswith(line, F.lit(" ")).cast("int") + F.endswith(line, F.lit(" ")).cast("int")
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    words = F.when(odd, F.regexp_count(line, F.lit(FILLED + "+"))).otherwise(spaces + 1 - ends)
    return F.when(F.octet_length(line) >= 2 * WORDS - 1, words >= WORDS).otherwise(F.lit(False))


def fingerprints(df: DataFrame, key: str, text: str, run: int = RUN) -> DataFrame:
    """A row per selected line: key, digest (of the text), print (its hash), long, ats and around: numbers and digests of the lines from run - 1 before it to run - 1 after it.

    Selected is the line of least hash in each window of `run` lines, the last of
    equal ones, and each line of WORDS words. Places beyond either end are null.
    """
    line = lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), _digest(x).alias("d"), _long(x).alias("long"), x.rlike(FILLED).alias("filled"))
    base = df.select(F.col(key).alias("key"), _digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.filter(F.transform(lines_of(F.col(text)), line), lambda x: x["filled"]).alias("lines"))

    around = F.transform("lines", lambda x, i: F.array(*[x if k == 0 else F.get("lines", i + k) for k in range(1 - run, run)]))
    each = base.select("key", "digest", F.explode(around).alias("w"))
    at = [F.col("w")[k] for k in range(2 * run - 1)]
    own = at[run - 1]
    beats = [F.coalesce(own["h"] <= x["h"] if k < run - 1 else own["h"] < x["h"], F.lit(False)) for k, x in enumerate(at)]
    # Least in the window that starts at k: all its other lines exist and are beaten.
    least = [reduce(lambda p, q: p & q, [beats[j] for j in range(k, k + run) if j != run - 1], F.lit(True)) for k in range(run)]
    chosen = each.where(reduce(lambda p, q: p | q, least) | own["long"])
    return chosen.select("key", "digest", own["h"].alias("print"), own["long"].alias("long"), F.col("w.at").alias("ats"), F.col("w.d").alias("around"))


def extended(prints: DataFrame, run: int = RUN) -> DataFrame:
    """(key, digest, ats, lines): what each fingerprint extends to: the windows of `run` lines that hold it, up to run - 1 lines back and on, and the line itself if it is long."""
    spans = [F.struct(F.slice("ats", k + 1, run).alias("ats"), F.slice("around", k + 1, run).alias("lines")) for k in range(run)]
    own = F.struct(F.slice("ats", run, 1).alias("ats"), F.slice("around", run, 1).alias("lines"))
    whole = F.filter(F.array(*spans), lambda w: ~F.exists(w["ats"], lambda a: a.isNull()))
    return prints.select("key", "digest", F.explode(F.when(F.col("long"), F.array_append(whole, own)).otherwise(whole)).alias("w")).select("key", "digest", "w.ats", "w.lines")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(key, digest, gone): the sorted numbers of the lines to delete, for each (key, text) that has any.

    A line goes if it is in `run` consecutive non-blank lines, or is one of WORDS
    words or more, that also stand, the same, at an earlier place: in a text of
    smaller (key, text digest), or further up in the same one. Null keys come first.
    """
    each = written(fingerprints(df, key, text, run), "prints")
    # Written and merged, so that the joins have plain exchanges on both sides at every size and a hot line can be split.
    shared = written(each.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print"), "shared")
    place = F.struct("key", "digest", F.col("ats")[0].alias("at"))
    several, _ = sifted(each, sieve(shared, "print"), "print")
    near = extended(several.join(shared.hint("merge"), "print", "left_semi"), run).withColumn("place", place)
    first = near.groupBy("lines").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select("lines", "first")
    later = near.join(written(first, "firsts").hint("merge"), "lines").where(F.col("place") > F.col("first"))
    return later.groupBy("key", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The array `lines` without the sorted positions `gone` (from 0), in time proportional to both."""
    last = F.lit(-1)
    froms = F.concat(F.array(last), gone)
    upto = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(froms, upto, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def with_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """df with column __gone: the numbers of the lines to delete (null if none).

    Only rows whose key and digest may have any move to the join.
    """
    with scratch(df.sparkSession) as keep:
        gone = keep(written(repeated_lines(df, key, text, run).select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), F.col("gone").alias("__gone")), "gone"))
        held = keep(sieve(gone, "__key", "__digest"))
    digest = _digest(F.coalesce(F.col(text), F.lit("")))
    some, none = sifted(df, held, F.col(key), digest)
    on = F.col(key).eqNullSafe(F.col("__key")) & (digest == F.col("__digest"))
    return some.join(gone.hint("merge"), on, "left").drop("__key", "__digest").unionByName(none.withColumn("__gone", F.lit(None).cast("array<int>")))


def kept_text(text: str) -> Column:
    return F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(without(lines_of(F.col(text)), F.col("__gone")), "\n"))


def drop_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """df with the later repeated runs of lines deleted from `text`; rows that nothing is left of go.

    Null and empty texts stay as they are. Texts of fewer than `run` non-blank
    lines match by lines of WORDS words alone. Rows that repeat both key and text are one document, so
    they don't delete each other. Other columns are kept.
    """
    cut = with_repeats(df, key, text, run).withColumn("__kept", kept_text(text))
    left = cut.where(F.col("__gone").isNull() | F.col("__kept").rlike(FILLED))
    return left.withColumn(text, F.col("__kept")).select(*df.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed (lines) and kept_sha256 of the text that is left.

    Null texts count as empty: one line, none removed. Rows that repeat doc_id and
    text share their result; ties of doc_id go by the text's digest. An empty
    table gives an empty one.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    left = F.coalesce(kept_text("text"), F.lit(""))
    return with_repeats(docs).select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(left, 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT doc_id, k, 1 AS more, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM filled
  UNION ALL
  SELECT doc_id, k, 0, line FROM filled WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50
), nth AS (
  SELECT doc_id, k, more, row_number() OVER (PARTITION BY more, run ORDER BY doc_id, k) AS n FROM runs WHERE run IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, k + j AS k FROM nth, (VALUES (0), (1)) t(j) WHERE n > 1 AND j <= more
), marked AS (
  SELECT l.doc_id, l.line, l.pos, gone.k IS NOT NULL AS dropped
  FROM l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.pos = f.pos
         LEFT JOIN gone ON f.doc_id = gone.doc_id AND f.k = gone.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
