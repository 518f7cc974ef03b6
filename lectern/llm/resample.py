"""Importance resampling towards a target distribution by an external sort-count of hashed words.

Every document becomes a stream of uint16 buckets, one for each feature (a word, or a run of
words); blocks of streams are written packed, with the end of each document in its block. A
block's buckets are sorted and run-length encoded, the runs are added up by bucket over all
blocks, and the two tables of counts (documents, target) give each bucket's gain. A later pass
gathers the gains of the streams and adds them up by document with np.add.reduceat. Documents
are drawn without replacement by the highest sums of weight and a Gumbel term of their id.

Defined cases: a null text has no words and weight 0; a null id is hashed as an empty string
and loses ties; repeated rows take part each on its own, in the order of the input; with an
empty target every gain comes from the documents alone; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.common import ALNUM_WORDS, Scratch
from lectern.llm.tokens import slices

#: Buckets of features; at most 65,536, as a bucket takes two bytes.
BUCKETS = 10_000
#: Words of the longest run that is a feature.
LONGEST = 1
SEED = 2024
#: Documents with fewer words are not drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 10
_TABLE = np.frombuffer(ALNUM_WORDS, np.uint8)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, and how many each text has."""
    texts = pa.array(texts.fill_null("").cast(pa.string()))
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_TABLE[data]))
    parts = pc.ascii_split_whitespace(plain)
    every, edges = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    real = np.asarray(pc.greater(pc.binary_length(every), 0))
    return every.filter(pa.array(real)), np.diff(np.r_[0, np.cumsum(real)][edges - edges[0]])


def bucketed(features: pa.Array, buckets: int) -> np.ndarray:
    """CRC-32 of each feature's bytes, modulo buckets; each different feature is hashed once."""
    told = features.dictionary_encode()
    kinds = np.array([zlib.crc32(w) % buckets for w in told.dictionary.cast(pa.binary()).to_pylist()], np.uint16)
    return kinds[np.asarray(told.indices)] if len(kinds) else np.zeros(0, np.uint16)


def stream(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, document by document, and how many features and how many words each text has."""
    every, n = words(texts)
    parts, counts = [bucketed(every, buckets)], [n]
    owner = np.repeat(np.arange(len(n)), n)
    owners = [owner]
    for size in range(2, longest + 1):
        at = np.arange(max(0, len(every) - size + 1))
        at = at[owner[at] == owner[at + size - 1]] if len(at) else at
        runs = pc.binary_join_element_wise(*(every.take(pa.array(at + k)) for k in range(size)), " ")
        parts.append(bucketed(runs, buckets))
        owners.append(owner[at])
        counts.append(np.maximum(n - size + 1, 0))
    if longest == 1:
        return parts[0], n, n
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(parts)[order], np.sum(counts, axis=0), n


def streams(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Blocks of bounded size: block (its number), ids, n_words and ends (by document), stream (packed uint16)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit in two bytes")
    kind = documents.schema[id_col].dataType
    schema = (T.StructType().add("block", "long").add("ids", T.ArrayType(kind)).add("n_words", T.ArrayType(T.IntegerType()))
              .add("ends", T.ArrayType(T.IntegerType())).add("stream", "binary"))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, to in slices(batch.column(1)):
                found, n, n_words = stream(batch.column(1).slice(at, to - at), buckets, longest)
                one = [[block], [batch.column(0).slice(at, to - at).to_pylist()], [n_words.tolist()], [np.cumsum(n).tolist()], [found.astype("<u2").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, arrow, strict=True)], schema=arrow)
                block += 1

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def counts(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): each block sorted and run-length encoded, runs added up by task and then over all tasks."""
    schema = T.StructType().add("bucket", "integer").add("n", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                ordered = np.sort(np.frombuffer(held.as_buffer(), "<u2"), kind="stable")
                if len(ordered):
                    edges = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1, len(ordered)]
                    total[ordered[edges[:-1]]] += np.diff(edges)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=arrow)

    return blocks.select("stream").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, from two tables of counts of at most `buckets` rows each."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, table in ((s, own), (t, target)):
        for r in table.collect():
            held[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """Per document of the blocks: doc_id, block and nth (its place), n_words, n_features, weight (sum of gains)."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = (T.StructType().add("doc_id", kind).add("block", "long").add("nth", "integer").add("n_words", "long").add("n_features", "long").add("weight", "long"))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, ids, n_words, ends, held = (batch.column(c)[k] for c in range(5))
                z = np.asarray(ends.values, np.int64)
                n = np.diff(np.r_[0, z])
                weight, some = np.zeros(len(z), np.int64), np.flatnonzero(n)
                if len(some):
                    weight[some] = np.add.reduceat(gain[np.frombuffer(held.as_buffer(), "<u2")], (z - n)[some])
                yield pa.RecordBatch.from_arrays([
                    ids.values, pa.array(np.full(len(z), block.as_py())), pa.array(np.arange(len(z), dtype=np.int32)),
                    n_words.values.cast(pa.int64()), pa.array(n), pa.array(weight),
                ], schema=arrow)

    return blocks.select("block", "ids", "n_words", "ends", "stream").mapInArrow(run, schema)


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate drawn from a hash of the id."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(told, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, scratch: Scratch, n: int, *order: Column) -> DataFrame:
    """rows with rank, 1 for the first, for the n first of them in the given total order; null for the others.

    Ranges of the order are sorted apart, and the numbers of rows in the ranges before each are added: one row per range.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = scratch.stored(sorted_, "ranked")
    scratch.keep_last()
    part = F.shiftrightunsigned("_at", 33)
    ranges = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ranges = ranges.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    met = held.join(F.broadcast(ranges), part == F.col("_part"))
    return met.withColumn("rank", F.when(rank <= n, rank)).drop("_at", "_part", "_before")


def resample(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS,
             longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank (from 1, in order of score, for those drawn; else null), n_words."""
    scratch = Scratch(documents.sparkSession)
    blocks = scratch.stored(streams(documents, id_col, text_col, buckets, longest), "streams")
    wanted = streams(target.select(F.lit(0).alias("item"), F.col(target_text_col).alias("text")), "item", "text", buckets, longest)
    found = weights(blocks, gains(counts(blocks, buckets), counts(wanted, buckets), buckets))
    scored = found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("short", F.col("n_words") < least_words)
    scored = scratch.stored(scored, "scored")
    scratch.keep_last()
    n = scored.where(~F.col("short")).count() * percent // 100
    order = (F.col("short").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block").asc(), F.col("nth").asc())
    return ranked(scored, scratch, n, *order).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def drawn(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, that resample() draws; ids must be unique."""
    picked = resample(documents, target, id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return documents.join(picked, F.col(id_col) == F.col("_drawn"), "left_semi")


#: DuckDB: the CRC-32 of each different word from its bytes and the table of the polynomial.
ORACLE = r"""
WITH RECURSIVE bit(b, k, v) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE k = 8),
dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
dt AS (SELECT r, unnest(w) AS x FROM dw),
bt AS (SELECT unnest(w) AS x FROM bw),
kind AS (SELECT x, list_transform(range(1, CAST(length(hex(x)) // 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(x), 2 * i - 1, 2) AS BIGINT)) AS y
         FROM (SELECT x FROM dt UNION SELECT x FROM bt)),
buck AS (SELECT x, xor(list_reduce(list_prepend(4294967295, y), lambda a, c: xor(a >> 8, t[xor(a & 255, c) + 1])), 4294967295) % 10000 AS b FROM kind, crc),
s AS (SELECT b, count(*) AS n FROM dt JOIN buck USING (x) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bt JOIN buck USING (x) GROUP BY b),
g AS (SELECT s.b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000)
             / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.b = t.b),
wt AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dt JOIN buck USING (x) JOIN g ON g.b = buck.b GROUP BY r),
sc AS (SELECT dw.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
       FROM dw LEFT JOIN wt ON dw.r = wt.r),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS k FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(*) * 10 // 100 FROM rk) THEN k END AS rank
FROM sc LEFT JOIN rk USING (r)
"""
