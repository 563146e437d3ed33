"""Suffix-array deduplication of byte strings that repeat across documents.

A byte goes if it lies in a string of LENGTH bytes that also starts in a
document of smaller doc_id. Only suffixes that can have a partner are sorted:

1. Equal texts are one text of their smallest doc_id; later copies go whole.
2. Each window of LENGTH bytes is named by the least hash among its grams of
   GRAM bytes, which depends on the window's content alone. Runs of windows
   with one name travel together. Names that only one document has are
   dropped: a first pass exchanges names (a few bytes each), no text.
3. The runs whose names are shared meet by name, with their bytes. Their suffixes
   are put in order by deep-shallow sorting: multikey quicksort on symbols of
   eight bytes to a shallow depth, then blind tries for the groups that still
   share a prefix. Equal neighbours to depth LENGTH form a class, and a window
   goes in all documents but the smallest of its class.
4. The byte ranges go back to the texts.

Equality is decided on bytes; hashes only decide what is compared.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, scratch, shipped, shuffle_width, sieve, sifted, written

LENGTH, GRAM = 50, 20
#: What a null key counts as.
LOWEST = -(1 << 63)
#: What tells different rows apart.
BOTH = ["digest", "first"]
#: Grams in a window; also the most windows in a run.
WIDE = LENGTH - GRAM + 1
#: Bytes of text that are worked on at once (a longer document is by itself).
CHUNK = 2 << 20
#: Bytes of a name that are exchanged, besides its bucket.
NAME = 4
#: Bytes that multikey quicksort sorts by; blind tries do the rest.
SHALLOW = 24
ROW = WIDE - 1 + LENGTH + (-(WIDE - 1 + LENGTH) % 8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the end."""
    v = np.concatenate((data, np.zeros(7, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        v = (v[:-width] << np.uint64(8 * width)) | v[width:]
    return v


def names(data: np.ndarray) -> np.ndarray:
    """For each window start, the least gram hash in the window."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = _eights(data)
    grams = len(data) - GRAM + 1
    h = eight[:grams] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(33)
    h += eight[8 : grams + 8]
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(33)
    h += eight[GRAM - 8 : grams + GRAM - 8]
    h = _mixed(h)
    width = 1
    while width < WIDE:
        step = min(width, WIDE - width)
        h = np.minimum(h[: len(h) - step], h[step:])
        width += step
    return h


def runs(data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, document index, first window start, windows) of each run in the concatenated texts."""
    ends = np.cumsum(lens)
    h = names(data)
    if not len(h):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    inside = np.zeros(len(h), bool)
    cut = np.zeros(len(h) + 1, bool)
    for s, e in zip((ends - lens).tolist(), ends.tolist(), strict=True):
        if e - s >= LENGTH:
            inside[s : e - LENGTH + 1] = True
            cut[s] = cut[e - LENGTH + 1] = True
    cut[0] = cut[len(h)] = True
    cut[1:-1] |= h[1:] != h[:-1]
    edge = np.flatnonzero(cut)
    start, size = edge[:-1], np.diff(edge)
    start, size = start[inside[start]], size[inside[start]]
    if len(size) and size.max() > WIDE:  # periodic text: any further cut is as good
        parts = -(-size // WIDE)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = np.repeat(start, parts) + at * WIDE, np.repeat(size, parts) - at * WIDE
        size = np.minimum(size, WIDE)
    return h[start], np.searchsorted(ends, start, side="right"), start, size


def _bucket_of(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    m = _mixed(name)
    return ((m >> np.uint64(8 * NAME)) % np.uint64(buckets)).astype(np.int64), m & np.uint64((1 << 8 * NAME) - 1)


def _short(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME].tobytes()


def _long(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // NAME, 8), np.uint8)
    wide[:, :NAME] = np.frombuffer(b, np.uint8).reshape(-1, NAME)
    return wide.view("<u8").ravel().astype(np.uint64)


def _squeezed(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which squeeze better than the values; np.cumsum restores these."""
    return np.diff(x, prepend=x.dtype.type(0))


def _restored(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.frombuffer(raw[: 8 * len(kinds)], "<u8").astype(np.int64)) + 8 * len(kinds)
    starts = np.concatenate(([8 * len(kinds)], ends[:-1]))
    return [np.frombuffer(raw, k, (e - s) // np.dtype(k).itemsize, s) for k, s, e in zip(kinds, starts.tolist(), ends.tolist(), strict=True)]


def _chunk_rows(batches):
    """Texts in the order that they come, squeezed as they come into chunks of CHUNK bytes: (chunk, ids, lens, data)."""
    import pyarrow as pa

    ids, lens, blob, packer, size = [], [], [], None, 0

    def row():
        blob.append(packer.flush())
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        columns = ([uuid.uuid4().hex], [ids], [lens], [b"".join(blob)])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "ids", "lens", "data"])

    for batch in batches:
        for i, body in zip(batch.column("first").to_pylist(), batch.column("body"), strict=True):
            if packer is None:
                packer = zstandard.ZstdCompressor(level=6).compressobj()
            held = body.as_buffer()
            ids.append(i)
            lens.append(held.size)
            blob.append(packer.compress(held))
            size += held.size + 16  # an empty text takes room too
            if size >= CHUNK:
                yield row()
                ids, lens, blob, packer, size = [], [], [], None, 0
    if ids:
        yield row()


def _text(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(row["data"]), np.uint8)
    return data, np.asarray(row["ids"], np.int64), np.asarray(row["lens"], np.int64)


def _named(buckets: int):
    """Per chunk and bucket: the names that one document (once) or several (many) of the chunk have."""

    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                data, _, lens = _text(row)
                name, doc, _, _ = runs(data, lens)
                if not len(name):
                    continue
                order = np.argsort(name, kind="stable")
                name, doc = name[order], doc[order]
                at = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
                many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                bucket, rest = _bucket_of(name[at], buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, rest, many = bucket[order], rest[order], many[order]
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                cells = [(int(bucket[s]), _short(rest[s:e][~many[s:e]]), _short(rest[s:e][many[s:e]])) for s, e in zip(edge[:-1], edge[1:], strict=True)]
                yield pd.DataFrame({"chunk": row["chunk"], "bucket": [c[0] for c in cells], "once": [c[1] for c in cells], "many": [c[2] for c in cells]})

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: per chunk the names that other documents have too."""
    once, many = [_long(b) for b in pdf["once"]], [_long(b) for b in pdf["many"]]
    every = np.sort(np.concatenate([*once, *many, *many]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for chunk, a, b in zip(pdf["chunk"], once, many, strict=True):
        if len(shared):
            a = a[shared[np.minimum(np.searchsorted(shared, a), len(shared) - 1)] == a]
        else:
            a = a[:0]
        if len(a) or len(b):
            out.append((chunk, int(pdf["bucket"].iloc[0]), _short(np.concatenate((a, b)))))
    return pd.DataFrame(out, columns=["chunk", "bucket", "names"])


def _sent(buckets: int):
    """Per chunk and bucket: the runs of shared names, with their bytes."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        wanted = {int(b): np.sort(_long(n)) for b, n in zip(right["bucket"], right["names"], strict=True)}
        for _, row in left.iterrows() if wanted else ():
            data, ids, lens = _text(row)
            name, doc, start, size = runs(data, lens)
            bucket, rest = _bucket_of(name, buckets)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                of = order[s:e]
                have = wanted.get(int(bucket[of[0]]))
                if have is None:
                    continue
                of = of[have[np.minimum(np.searchsorted(have, rest[of]), len(have) - 1)] == rest[of]]
                long = size[of] + LENGTH - 1
                at = np.repeat(start[of] - np.cumsum(long) + long, long) + np.arange(long.sum())
                out.append((row["chunk"], int(bucket[of[0]]) if len(of) else 0, _squeezed(_steps(ids[doc[of]]), _steps(start[of]), size[of].astype(np.uint8), data[at])))
        return pd.DataFrame(out, columns=["chunk", "bucket", "runs"])

    return run


def blind_tries(strings: list[int], width: int) -> tuple[list[int], list[int]]:
    """Order and class of strings of `width` bytes (as big-endian numbers): equal strings share a class.

    A blind trie keeps only the depths at which strings part. A string goes down
    by the bytes at those depths, is compared once with the leaf that it comes
    to, and that one comparison tells where it branches off.
    """
    root: list | int = 0
    classes = [0] * len(strings)
    top = 8 * width
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while type(node) is list:
            kids = node[1]
            node = kids.get(s >> (top - 8 - 8 * node[0]) & 255)
            if node is None:
                node = next(iter(kids.values()))
        differ = s ^ strings[node]
        if not differ:
            classes[i] = node
            continue
        classes[i] = i
        depth = (top - differ.bit_length()) // 8
        above, node = None, root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][s >> (top - 8 - 8 * node[0]) & 255]
        byte = s >> (top - 8 - 8 * depth) & 255
        if type(node) is list and node[0] == depth:
            node[1][byte] = i
            continue
        leaf = node
        while type(leaf) is list:
            leaf = next(iter(leaf[1].values()))
        made = [depth, {strings[leaf] >> (top - 8 - 8 * depth) & 255: node, byte: i}]
        if above is None:
            root = made
        else:
            above[1][s >> (top - 8 - 8 * above[0]) & 255] = made
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            order.append(node)
    return order, classes


def suffix_classes(text: np.ndarray, at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting: (order, class) of the suffixes text[at : at + LENGTH] in each segment.

    order sorts the suffixes by (segment, bytes). Suffixes of a segment have one
    class number if and only if all LENGTH bytes are equal.
    """
    eight = _eights(text)
    order = np.argsort(segment, kind="stable")
    group = segment[order]
    n = len(order)
    for depth in range(0, SHALLOW, 8):  # multikey quicksort, all open groups at once: equal symbols go on to the next
        symbol = eight[at[order] + depth]
        new = np.lexsort((symbol, group))
        order, symbol, group = order[new], symbol[new], group[new]
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])))
        group = np.cumsum(fresh) - 1
    edge = np.concatenate((np.flatnonzero(fresh), [n]))
    size = np.diff(edge)
    number = np.arange(n)  # class of each place in the order: the first place of its equals
    two = edge[:-1][size == 2]
    if len(two):  # a blind trie of two leaves: one comparison
        a, b = at[order[two]], at[order[two + 1]]
        same = np.ones(len(two), bool)
        less = np.zeros(len(two), bool)
        for depth in (*range(SHALLOW, LENGTH - 7, 8), LENGTH - 8):
            x, y = eight[a + depth], eight[b + depth]
            less |= same & (y < x)
            same &= x == y
        number[two[same] + 1] = two[same]
        swap = two[less]
        order[swap], order[swap + 1] = order[swap + 1], order[swap]
    for s, e in zip(edge[:-1][size > 2].tolist(), edge[1:][size > 2].tolist(), strict=True):
        own = order[s:e].copy()
        keys = [int.from_bytes(text[p + SHALLOW : p + LENGTH].tobytes()) for p in at[own].tolist()]
        leaves, classes = blind_tries(keys, LENGTH - SHALLOW)
        rank = {leaf: r for r, leaf in enumerate(leaves)}
        ranks = np.array([rank[c] for c in classes])
        new = np.argsort(ranks, kind="stable")
        order[s:e] = own[new]
        number[s:e] = s + np.searchsorted(ranks[new], ranks[new])
    classes = np.empty(n, np.int64)
    classes[order] = number
    return order, classes


def _gone(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: per chunk the byte ranges that go."""
    parts = [_restored(b, "<i8", "<i8", "u1", "u1") for b in pdf["runs"]]
    doc, start = (np.concatenate([np.cumsum(p[k]) for p in parts]) for k in (0, 1))
    size, text = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
    chunk = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    size = size.astype(np.int64)
    n = len(doc)
    empty = pd.DataFrame({"chunk": [], "ranges": []})
    if not n:
        return empty
    long = size + LENGTH - 1
    offset = np.cumsum(long) - long
    name = names(text)[offset]  # all windows of a run have the same one
    # Runs of equal bytes are one content, with its smallest document.
    rows = np.zeros((n, ROW), np.uint8)
    rows[np.repeat(np.arange(n), long), np.arange(len(text)) - np.repeat(offset, long)] = text
    words = rows.view(np.uint64)
    mark = size.astype(np.uint64)
    for k in range(words.shape[1]):
        mark = _mixed(mark + words[:, k])
    order = np.lexsort((mark, name))
    same = (name[order[1:]] == name[order[:-1]]) & (size[order[1:]] == size[order[:-1]]) & (words[order[1:]] == words[order[:-1]]).all(axis=1)
    first = np.concatenate(([True], ~same))
    content = np.empty(n, np.int64)
    content[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    lead = order[at]
    least = np.minimum.reduceat(doc[order], at)
    # Contents that share a name are held against each other, window by window.
    group = np.cumsum(np.concatenate(([True], name[lead[1:]] != name[lead[:-1]]))) - 1
    mixed = np.bincount(group)[group] > 1
    windows = size[lead]
    base = np.cumsum(windows) - windows
    low = np.repeat(least, windows)
    if mixed.any():
        of = np.repeat(np.arange(len(lead)), windows)
        step = np.arange(len(of)) - base[of]
        pick = np.flatnonzero(mixed[of])
        _, classes = suffix_classes(text, offset[lead[of[pick]]] + step[pick], group[of[pick]])
        best = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(best, classes, low[pick])
        low[pick] = best[classes]
    # Each run's windows against the smallest document that has them.
    run = np.repeat(np.arange(n), size)
    step = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    out = low[base[content[run]] + step] < doc[run]
    head = out & np.concatenate(([True], (run[1:] != run[:-1]) | ~out[:-1]))
    tail = out & np.concatenate(((run[1:] != run[:-1]) | ~out[1:], [True]))
    froms, upto = start[run[head]] + step[head], start[run[tail]] + step[tail] + LENGTH
    where = chunk[run[head]]
    result = []
    edge = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        result.append((pdf["chunk"].iloc[where[s]], _squeezed(froms[s:e], upto[s:e])))
    return pd.DataFrame(result, columns=["chunk", "ranges"]) if result else empty


def _finished(with_text: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            data, ids, lens = _text(row)
            mark = np.zeros(len(data) + 1, np.int32)
            for blob in right["ranges"]:
                froms, upto = _restored(blob, "<i8", "<i8")
                np.add.at(mark, froms, 1)
                np.subtract.at(mark, upto, 1)
            gone = np.cumsum(mark[:-1]) > 0
            for i, s, e in zip(ids.tolist(), (np.cumsum(lens) - lens).tolist(), np.cumsum(lens).tolist(), strict=True):
                g = gone[s:e]
                body = data[s:e].tobytes()
                kept = data[s:e][~g].tobytes() if g.any() else body
                spans = int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1))
                r = [i, hashlib.sha256(body).digest()[:16], int(g.sum()), spans, hashlib.sha256(kept).hexdigest()]
                out.append([*r, kept.decode("utf-8", "ignore") if spans else None] if with_text else r)
        return pd.DataFrame(out, columns=["first", "digest", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return run


def _least(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit(LOWEST))


def _body(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _digest(text: str) -> Column:
    """Half of the SHA-256."""
    return F.unhex(F.substring(F.sha2(_body(text), 256), 1, 32))


def later_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keys, later): (digest, first) of every row, and distinct of those whose text stands in a row of a smaller key. Written tables without texts."""
    keys = written(df.select(_digest(text).alias("digest"), _least(key).alias("first")), "keys")
    # Written and merged, so that the join has plain exchanges on both sides and a hot text can be split.
    groups = written(keys.groupBy("digest").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("digest", "least"), "groups")
    return keys, written(keys.join(groups.hint("merge"), "digest").where("first > least").select("digest", "first").distinct(), "later")


def without_copies(df: DataFrame, keys: DataFrame, later: DataFrame, key: str, text: str) -> DataFrame:
    """(first, digest, body) of the rows that are no later copies, once each.

    Bodies stay where they are, but for those of rows that repeat both key and text
    and those that the sieve of copies holds by chance.
    """
    own = df.select(_least(key).alias("first"), _digest(text).alias("digest"), _body(text).cast("binary").alias("body"))
    stay = others(own, keys, later, BOTH)
    again = written(keys.groupBy(*BOTH).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*BOTH), "again")
    twice, once = sifted(stay, sieve(again, *BOTH), *BOTH)
    return once.unionByName(twice.dropDuplicates(BOTH))


def others(df: DataFrame, keys: DataFrame, named: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose columns `on` are not in `named`. keys: these columns of all rows, as a written table.

    Rows that a sieve lets pass don't move; of the others only the keys do, and
    then the few that it holds by chance.
    """
    held = sieve(named, *on)
    chance = written(sifted(keys, held, *on)[0].join(named.hint("merge"), on, "left_anti").distinct(), "chance")
    maybe, sure = sifted(df, held, *on)
    return sure.unionByName(sifted(maybe, sieve(chance, *on), *on)[0].join(chance.hint("merge"), on, "left_semi"))


def repeats(df: DataFrame, copies: tuple[DataFrame, DataFrame], key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """For each different text: first (its least key), digest (half of its SHA-256), n_removed, n_spans, kept_sha256[, kept].

    copies: later_copies() of df. Judged on the whole UTF-8 bytes, for the document
    `first`. Null text: empty. A null key counts as the smallest long. kept is null
    where nothing goes, and leaves out bytes of characters that a cut goes
    through. An empty table gives an empty one.
    """
    spark = df.sparkSession
    shipped(spark)
    chunks = written(without_copies(df, *copies, key, text).mapInArrow(_chunk_rows, "chunk string, ids array<long>, lens array<long>, data binary"), "chunks")
    buckets = max(shuffle_width(spark), chunks.count() // 4)
    named = chunks.mapInPandas(_named(buckets), "chunk string, bucket long, once binary, many binary")
    shared = named.groupBy("bucket").applyInPandas(_shared, "chunk string, bucket long, names binary")
    sent = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(_sent(buckets), "chunk string, bucket long, runs binary")
    gone = sent.groupBy("bucket").applyInPandas(_gone, "chunk string, ranges binary")
    schema = "first long, digest binary, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    done = chunks.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInPandas(_finished(with_text), schema)
    # Written, so that the join with the rows has plain exchanges on both sides and a hot text can be split.
    return written(done, "repeats")


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeated bytes cut out of `text`; rows of which nothing is left go, empty texts stay.

    Rows that repeat both key and text are one document: neither cuts the other.
    Only rows that may change move to the join with what is left of them.
    """
    spark = df.sparkSession
    with scratch(spark) as keep:
        copies = later_copies(df, key, text)
        cut = repeats(df, copies, key, text, with_text=True).where("n_removed > 0").select("digest", "first", "kept")
        gone = copies[1].withColumn("kept", F.lit(""))
        changes = keep(written(cut.unionByName(gone).select(F.col("digest").alias("__digest"), F.col("first").alias("__first"), F.col("kept").alias("__kept")), "changes"))
        # Copies that are too short to hold a repeat stay as they are.
        short = df.select(_digest(text).alias("__digest"), F.octet_length(_body(text)).alias("__n")).where(F.col("__n") < LENGTH).select("__digest").distinct()
        changes = keep(written(changes.join(short.hint("merge"), "__digest", "left_anti"), "changes"))
        keys = copies[0].select(F.col("digest").alias("__digest"), F.col("first").alias("__first"))
        at = ["__digest", "__first"]
        held = keep(sieve(changes, *at))
        chance = keep(written(sifted(keys, held, *at)[0].join(changes.hint("merge"), at, "left_anti").distinct(), "chance"))
        held_by_chance = keep(sieve(chance, *at))
    own = df.withColumn("__digest", _digest(text)).withColumn("__first", _least(key))
    some, same = sifted(own, held, *at)
    back = sifted(some, held_by_chance, *at)[0].join(chance.hint("merge"), at, "left_semi")
    # The texts of these rows are replaced, so they don't move.
    met = some.drop(text).join(changes.where(F.col("__kept") != "").hint("merge"), at).withColumnRenamed("__kept", text)
    return met.select(*df.columns).unionByName(same.select(*df.columns)).unionByName(back.select(*df.columns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes.

    Null texts count as empty. A null doc_id counts as smaller than any other. Rows
    that repeat doc_id and text are one document; different texts of one doc_id
    never cut each other. Later copies of a text of LENGTH bytes go whole. An
    empty table gives an empty one. Other columns are not read.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    with scratch(spark) as keep:
        found = keep(repeats(docs, later_copies(docs)))
    # No texts move here: sizes and digests are taken first.
    own = docs.select("doc_id", F.octet_length(_body("text")).cast("long").alias("n_bytes"), _digest("text").alias("digest"))
    met = own.join(found.hint("merge"), "digest")
    later = _least("doc_id") > F.col("first")
    whole, short = later & (F.col("n_bytes") >= LENGTH), later & (F.col("n_bytes") < LENGTH)
    return met.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(short, 0).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, 1).when(short, 0).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
