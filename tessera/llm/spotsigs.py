"""SpotSigs document fingerprints, in DataFrame operations only.

A signature is a common word (an anchor) with the chain of content words that
follow it; the signatures of a text form its fingerprint, and the likeness of
two texts is the Jaccard likeness of their signature sets. For near duplicates,
texts are partitioned by the size of their sets, so that only sets of about
equal size meet, and only those that share one of their rarest signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, shuffle_width, written
from tessera.llm.similarity import jaccard, linked

#: Common words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au de des du en est et la le les pas pour que qui une un sur dans "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "con del el las los no para por se su y"
).split()
#: Content words after an anchor; a content word also serves as an anchor if its hash is a multiple of SPARSE,
#: so that texts that avoid common words have signatures, and so does the first word of a text.
CHAIN, SPARSE = 2, 16
MARK = "\x01"


def signatures(text: Column) -> Column:
    """The sorted distinct 64-bit signatures of a text: empty without any word, null counts as empty.

    Words are runs of letters and digits, lower-cased. Of several common words in
    a row the last one is the anchor. A chain that the end of the text cuts short
    is taken as it is.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # No repeated group in the pattern: Java would recurse once for each common word in a row.
    glued = F.regexp_replace(plain, f" ({'|'.join(COMMON)})(?= )", f" $1{MARK}")
    glued = F.replace(glued, F.lit(f"{MARK} "), F.lit(MARK))
    tokens = F.filter(F.split(glued, " "), lambda t: t != "")
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, MARK, -1).alias("w"), F.when(F.contains(t, F.lit(MARK)), F.substring_index(F.substring_index(t, MARK, -2), MARK, 1)).alias("anchor")))
    hashed = F.transform(pairs, lambda p: F.struct(F.xxhash64(p["w"]).alias("h"), p["anchor"].alias("anchor")))

    def at(whole):
        def one(p, i):
            serves = p["anchor"].isNotNull() | (i == 0) | (p["h"] % SPARSE == 0)
            chain = [F.get(whole, i + k)["h"] for k in range(CHAIN)]
            return F.when(serves, F.xxhash64(F.coalesce(p["anchor"], F.lit("")), *chain))

        return F.filter(F.transform(whole, one), lambda s: s.isNotNull())

    # The array is bound once, as the one element of an outer array.
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array(hashed), at))))


def digest(sigs: Column) -> Column:
    """32 hexadecimal digits that stand for a signature set."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), sigs))), 16, "0") for seed in ("spot", "signature")])


def length_class(n: Column, threshold: float) -> Column:
    """Sizes whose sets can be `threshold` alike are in the same class or in adjacent ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(key, class_id, n_links) per row: texts whose signature sets are `threshold` alike or more link.

    class_id is the least key that is reachable; n_links counts the rows of the
    class besides this one. Equal sets are one node, so copies are not paired.
    Texts without a word form one class. Null keys are ignored as class_id unless
    all keys of the class are null.
    """
    rows = written(df.select(F.col(key).alias("key"), signatures(F.col(text)).alias("set")).withColumn("digest", digest(F.col("set"))), "spots")
    unique = rows.groupBy("digest").agg(F.first("set").alias("set"))
    nodes = written(unique.select(F.monotonically_increasing_id().alias("node"), "digest", "set", F.size("set").alias("n")), "spotnodes")
    sets = nodes.where("n > 0").select("node", "n", F.explode("set").alias("sig"))
    rare = sets.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Of n signatures, two sets that are alike share one of the n - ceil(threshold n) + 1 rarest of either.
    ranked = sets.join(rare, "sig", "left").withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "sig")))
    prefix = ranked.where((F.col("nth") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("df").isNotNull())
    cls = length_class(F.col("n"), threshold)
    members = prefix.select(F.explode(F.array(cls, cls + 1)).alias("cls"), "sig", "node").select(F.xxhash64("cls", "sig").alias("bucket"), "node").distinct()
    attributes = nodes.select("node", "n")
    groups = linked(written(members, "spotmembers"), attributes, threshold, lambda want: nodes.join(want, "node", "left_semi").select("node", "set"))
    labelled = nodes.select("node", "digest").join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    per_digest = rows.groupBy("digest").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    per_class = labelled.join(per_digest, "digest").groupBy("component").agg(F.min("low").alias("class_id"), F.sum("n").alias("n"))
    return rows.select("key", "digest").join(labelled, "digest").join(per_class, "component").select(F.col("key").alias(key), "class_id", (F.col("n") - 1).alias("n_links"))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by binary search."""
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def step(at, _):
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        past = F.get(array, mid) <= key
        open_ = at["low"] < at["high"]
        return F.struct(F.when(open_ & past, mid + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~past, mid).otherwise(at["high"]).alias("high"))

    return F.aggregate(steps, start, step)["low"]


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, text, range, end, next), with one more row (end = 1) after each range: next is the text of the row after, by ascending key; after the last comes the first.

    Null keys come first; ties are ordered by text. Rows are dealt to ranges of
    keys, and each range also gets the first row of the next one, so that no task
    sees more than a range.
    """
    spark = df.sparkSession
    own = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    ids = df.select(own.alias("id"))
    ranges = 4 * shuffle_width(spark)  # bounded: the session says how many tasks its data call for
    cuts = ids.agg(F.percentile_approx("id", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(100 * ranges))).first()[0] or []
    bounds = sorted(set(cuts))
    rows = df.select(F.col(key).alias("key"), own.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("range", _bucket(F.col("id"), bounds))
    firsts = rows.select("range", "id").groupBy("range").agg(F.min("id").alias("id"))
    heads = firsts.select(F.col("id").alias("head"), F.lag("range").over(Window.orderBy("range")).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    heads = heads.select("head", F.coalesce("before", "last").alias("range"))  # a row for each range, so at most `ranges`
    ends = rows.select("id", "text").join(F.broadcast(heads), F.col("id") == F.col("head")).groupBy("range", "id").agg(F.min("text").alias("text"))
    both = rows.select("key", "id", "text", "range", F.lit(0).alias("end")).unionByName(ends.select(F.lit(None).cast(df.schema[key].dataType).alias("key"), "id", "text", "range", F.lit(1).alias("end")))
    order = Window.partitionBy("range").orderBy("end", "id", "text")
    return both.withColumn("next", F.lead("text").over(order))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    A single document is its own next one. Null keys come first; an empty table
    gives an empty one. Ties of doc_id are ordered by text.
    """
    paired = with_next(documents(spark, sf_dir), "doc_id", "text")
    n, share = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - share), F.col("next").substr(F.lit(1), share))
    order = Window.partitionBy("range").orderBy("end", "id", "text")
    shown = paired.withColumn("edited", edited).withColumn("sigs", signatures(F.col("text")))
    shown = shown.withColumn("next_sigs", F.lead("sigs").over(order)).where("end = 0")
    shown = shown.withColumn("edited_sigs", signatures(F.col("edited")))
    return shown.select(
        F.col("key").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("sigs")).alias("fingerprint"),
        digest(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
