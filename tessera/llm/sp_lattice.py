"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units at places that no piece of the vocabulary spans, so a
unit's ids don't depend on its surroundings. The different units form a table:
their substrings of bounded length are exploded and joined with the piece
table, and the matches, grouped by unit, are the edges of its lattice. A
higher-order aggregate folds each lattice: for unigram models Viterbi's best
path; for BPE models, whose encoding is no best path, the merges in the order of
their scores, each of them an edge. The most frequent units, a bounded number that
makes up almost all of a text, are encoded so once for the whole corpus.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, shipped, written

SPACE = "▁"
#: Characters of text whose units are counted before the counts move on.
CHUNK = 4 << 20
#: Counts that a worker hands on at once.
ROWS = 1 << 15
#: Units whose lattices are folded: the most frequent ones, so that their ids can be broadcast.
MOST = 1 << 18
#: Ids of rarer units that a worker remembers.
KEPT = 1 << 16
#: Units of more characters than this are merged one by one instead: a fold takes time with the square of the length.
LONG = 32
#: Characters below this are looked up pairwise for cuts; next to others nothing is cut.
NARROW = 0x180


class Model:
    """Pieces, scores and rules of a SentencePiece model file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        self.score = {p: (sp.get_score(i), i) for i, p in enumerate(self.pieces) if not special[i]}
        self.worth = {p: s for p, (s, _) in self.score.items()}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        spec = dict(_fields(sp.serialized_model_proto()))
        normalizer, trainer = dict(_fields(spec[3])), dict(_fields(spec[2]))
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        if normalizer.get(1) != b"identity" or normalizer.get(4, 1) or not normalizer.get(3, 1) or self.kind is None or not self.byte:
            raise ValueError(f"{path}: only identity normalisation with a dummy prefix, kept white space and byte pieces is known")
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError(f"{path}: pieces reach over words")
        self.longest = max(map(len, self.score))
        self.joined = np.zeros((NARROW + 1, NARROW + 1), bool)  # index NARROW: the space mark
        narrow = lambda c: NARROW if c == SPACE else ord(c)
        for p in self.score:
            for a, b in zip(p, p[1:]):
                if narrow(a) <= NARROW and narrow(b) <= NARROW:
                    self.joined[narrow(a), narrow(b)] = True
        self.shown = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte.items():
            self.shown[i] = bytes([b])
        for i in range(size):
            if sp.is_control(i):
                self.shown[i] = b""

    def ids(self, unit: str, cuts: list[int]) -> list[int]:
        out = []
        for s, e in zip(cuts, cuts[1:]):
            known = self.score.get(unit[s:e])
            if known:
                out.append(known[1])
            else:
                out += [self.byte[b] for b in unit[s:e].encode("utf-8", "surrogatepass")]
        return out

    def units(self, text: str) -> list[str]:
        """The text, prefixed and with marked spaces, cut where no piece can lie across."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = x == ord(SPACE)
        narrow = np.where(space, NARROW, np.minimum(x, NARROW + 1))
        known = narrow <= NARROW
        a, b = np.minimum(narrow[:-1], NARROW), np.minimum(narrow[1:], NARROW)
        cut = known[:-1] & known[1:] & ~self.joined[a, b]
        cut |= ~space[:-1] & space[1:]
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(text)]
        return [text[s:e] for s, e in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " and ids and self.pieces[ids[0]][:1] == SPACE else text


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Numbered fields of a serialised message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            c = b[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(b):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, b[at : at + size]
            at += size


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def loaded(path: str) -> Model:
    return Model(path)


def merged(unit: str, model: Model) -> list[int]:
    """Cuts of one long unit: the merges of BPE by a heap over linked characters."""
    n = len(unit)
    right, left, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(s):
        m = right[s] if s >= 0 else n
        if s >= 0 and m < n:
            known = model.score.get(unit[s : right[m]]) if right[m] - s <= model.longest else None
            if known:
                heapq.heappush(heap, (-known[0], s, right[m]))

    for s in range(n - 1):
        offer(s)
    while heap:
        _, s, e = heapq.heappop(heap)
        m = right[s]
        if not live[s] or m >= n or right[m] != e:
            continue
        live[m] = False
        right[s] = e
        if e < n:
            left[e] = s
        offer(s)
        offer(left[s])
    return [s for s in range(n) if live[s]] + [n]


def alone(unit: str, model: Model) -> list[int]:
    """Cuts of one rare unit, as merged() gives them: the worth of each two neighbours is kept in a list, where short units are soon searched."""
    if len(unit) > LONG:
        return merged(unit, model)
    worth_of, none = model.worth.get, -np.inf
    cuts = list(range(len(unit) + 1))
    worth = [worth_of(unit[s : s + 2], none) for s in range(len(unit) - 1)]
    while worth and (best := max(worth)) != none:
        at = worth.index(best)
        del cuts[at + 1], worth[at]
        if at < len(worth):
            worth[at] = worth_of(unit[cuts[at] : cuts[at + 2]], none)
        if at:
            worth[at - 1] = worth_of(unit[cuts[at - 1] : cuts[at + 1]], none)
    return cuts


def best_path(unit: str, model: Model) -> list[int]:
    """Cuts of one long unit: Viterbi, as fold_viterbi does it."""
    low = min(s for s, _ in model.score.values()) - 10
    n = len(unit)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - model.longest), e):
            known = model.score.get(unit[s:e])
            worth = best[s] + known[0] if known else best[s] + low if e - s == 1 else -np.inf
            if worth > best[e]:
                best[e], back[e] = worth, s
    cuts = [n]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def fold_merges(n: Column, edges: Column) -> Column:
    """Cuts of a BPE encoding: from single characters, the best-scored merge of two neighbours, leftmost first, again and again."""

    def step(cuts, _):
        here = lambda e: F.array_position(cuts, e["start"]).cast("int")
        open_ = F.filter(edges, lambda e: (here(e) > 0) & F.coalesce(F.get(cuts, here(e) + 1) == e["stop"], F.lit(False)))
        best = F.array_max(F.transform(open_, lambda e: F.struct(e["score"].alias("score"), (-e["start"]).alias("back"))))
        middle = F.get(cuts, F.array_position(cuts, -best["back"]).cast("int"))
        return F.when(best.isNull(), cuts).otherwise(F.array_remove(cuts, middle))

    return F.aggregate(F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>")), F.sequence(F.lit(0), n), step)


def fold_viterbi(n: Column, edges: Column, low: float) -> Column:
    """Cuts of the best path: for each end in order the best sum of scores so far and its last cut.

    Single characters without a piece score `low`. The longest last piece wins a tie.
    """
    entry = "array<struct<worth:double,back:int>>"

    def step(done, e):
        into = F.filter(edges, lambda x: x["stop"] == e)
        ways = F.transform(into, lambda x: F.struct((F.get(done, x["start"])["worth"] + x["score"]).alias("worth"), (-x["start"]).alias("back")))
        single = F.struct((F.get(done, e - 1)["worth"] + F.lit(low)).alias("worth"), (1 - e).alias("back"))
        known = F.exists(into, lambda x: x["start"] == e - 1)
        best = F.array_max(F.when(known, ways).otherwise(F.concat(ways, F.array(single))))
        return F.concat(done, F.array(F.struct(best["worth"].alias("worth"), (-best["back"]).alias("back"))).cast(entry))

    ends = F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("worth"), F.lit(0).alias("back"))).cast(entry), step)

    def walk(cuts, _):
        return F.when(F.get(cuts, F.lit(0)) == 0, cuts).otherwise(F.concat(F.array(F.get(ends_of, F.get(cuts, F.lit(0)))["back"]), cuts))

    # The table of ends is bound once, as the one element of an outer array.
    def trace(table):
        nonlocal ends_of
        ends_of = table
        return F.aggregate(F.sequence(F.lit(1), n), F.array(n), walk)

    ends_of: Column = ends
    return F.get(F.transform(F.array(ends), trace), F.lit(0))


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, score): as many rows as the vocabulary has."""
    return spark.createDataFrame(pd.DataFrame({"piece": list(model.score), "score": [s for s, _ in model.score.values()]}), "piece string, score double")


def lattices(units: DataFrame, pieces: DataFrame, longest: int, shortest: int) -> DataFrame:
    """(unit, edges) for units (unit): edges are the structs (start, stop, score) of the substrings that are pieces, or null."""
    n = F.char_length("unit")
    starts = units.repartition("unit").select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    room = F.least(F.lit(longest), n - F.col("start"))
    stops = F.when(room >= shortest, F.sequence(F.lit(shortest), room)).otherwise(F.array().cast("array<int>"))
    each = starts.select("unit", "start", F.explode_outer(stops).alias("size")).withColumn("piece", F.expr("substring(unit, start + 1, size)"))
    edge = F.when(F.col("score").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("stop"), "score"))
    matched = each.join(F.broadcast(pieces), "piece", "left")  # a row for each piece of the vocabulary
    return matched.groupBy("unit").agg(F.collect_list(edge).alias("edges"))


def segmented(units: DataFrame, model: Model) -> DataFrame:
    """(unit, cuts) for every unit: positions from 0 to its length at which its pieces meet."""
    bpe = model.kind == "bpe"
    table = lattices(units, piece_table(units.sparkSession, model), model.longest, 2 if bpe else 1)
    n = F.char_length("unit")
    low = min(s for s, _ in model.score.values()) - 10
    return table.select("unit", (fold_merges(n, F.col("edges")) if bpe else fold_viterbi(n, F.col("edges"), low)).alias("cuts"))


def counted(rows: DataFrame, path: str) -> DataFrame:
    """(unit, n) for the units of up to LONG characters in all texts: each CHUNK is counted before anything moves."""

    import pyarrow as pa

    def handed(seen):
        pairs = iter(seen.items())
        while part := list(islice(pairs, ROWS)):
            units, times = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(times, pa.int64())], ["unit", "n"])

    def run(batches):
        model, seen, size = loaded(path), Counter(), 0
        for batch in batches:
            for text in batch.column("text"):  # one text at a time
                text = text.as_py()
                if text:
                    seen.update(u for u in model.units(text) if len(u) <= LONG)
                    size += len(text)
                if size >= CHUNK:
                    yield from handed(seen)
                    seen, size = Counter(), 0
        yield from handed(seen)

    return rows.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


class Known:
    """Ids of units, sent packed: a broadcast of few large objects. A worker unpacks them once."""

    def __init__(self, units: list[bytes], ids: list[bytes]):
        self.packed = [(b"".join(x), np.cumsum([0, *map(len, x)], dtype=np.int64)) for x in (units, ids)]
        self._table: dict[str, bytes] | None = None

    def __getstate__(self):
        return {"packed": self.packed, "_table": None}

    def table(self) -> dict[str, bytes]:
        if self._table is None:
            (units, unit_at), (ids, id_at) = ((raw, at.tolist()) for raw, at in self.packed)
            self._table = {
                units[s:e].decode("utf-8", "surrogatepass"): ids[i:j] for s, e, i, j in zip(unit_at, unit_at[1:], id_at, id_at[1:])
            }
        return self._table


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The units of largest counts, up to `most` of them, cut at a power of the fourth root of two."""
    level = F.floor(F.log2("n") * 4).cast("int")
    held, least = 0, 1 << 30
    sizes = {r["level"]: r["units"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("units")).collect()}  # at most 4 * 63 rows
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > most:
            break
        least = at
    return counts.where(level >= least).select("unit")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, most: int = MOST) -> DataFrame:
    """(key, ids array<int>) per row: the ids that SentencePiece gives for the whole text.

    Null and empty texts have no ids. Characters without a piece become byte
    pieces. Repeated rows are encoded each; other columns are not read. The ids of
    the `most` most frequent units come from their lattices and are broadcast, as
    `most` bounds them; rarer and longer units are merged where they stand, to the
    same ids.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    spark = df.sparkSession
    shipped(spark)
    path = path or model_path()
    rows = df.select(F.col(key), F.col(text).alias("text"))
    counts = written(counted(rows, path), "spunits")
    model = loaded(path)
    cuts = segmented(frequent(counts, most), model)

    def found(batches):
        model = loaded(path)
        for batch in batches:
            ids = [np.array(model.ids(u, list(c)), "<u4").tobytes() for u, c in zip(batch["unit"], batch["cuts"], strict=True)]
            yield pd.DataFrame({"unit": batch["unit"], "ids": ids})

    pairs = cuts.mapInPandas(found, "unit string, ids binary").toPandas()  # at most `most` rows
    shared = spark.sparkContext.broadcast(Known([u.encode("utf-8", "surrogatepass") for u in pairs["unit"]], [bytes(i) for i in pairs["ids"]]))
    del pairs

    def run(batches):
        model, known = loaded(path), shared.value.table()
        rest: dict[str, bytes] = {}

        def rare(unit):
            if len(rest) > KEPT:
                rest.clear()
            ids = rest[unit] = np.array(model.ids(unit, single(unit, model)), "<u4").tobytes()
            return ids

        single = alone if model.kind == "bpe" else best_path
        for batch in batches:
            parts = [b"".join([known.get(u) or rest.get(u) or rare(u) for u in model.units(t.as_py() or "")]) for t in batch.column("text")]
            ends = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    return rows.mapInArrow(run, StructType([df.schema[key]]).add("ids", ArrayType(IntegerType())))


def decode(df: DataFrame, ids: str = "ids", name: str = "text", path: str | None = None) -> DataFrame:
    """df with string column `name`: the text of each array of ids (null for null); other columns stay."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructType

    shipped(df.sparkSession)
    path = path or model_path()
    keep = [c for c in df.columns if c != name]

    def run(batches):
        model = loaded(path)
        for batch in batches:
            texts = [None if i is None else model.decode(i.tolist()) for i in (x.values.to_numpy() if x.is_valid else None for x in batch.column("__ids"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, name])

    schema = StructType([df.schema[c] for c in keep]).add(name, StringType())
    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids, and the SHA-256 of the text decoded from them."""
    encoded = encode(documents(spark, sf_dir))
    return decode(encoded).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))
