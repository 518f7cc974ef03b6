"""Token-ID output: Parquet list columns with delta or dictionary encoding, bounded row groups and page indexes.

Documents are encoded where they lie. Their ids, two bytes each where the vocabulary allows
it, are then dealt to ranges of (id, place) whose bounds come from a bounded sample of ids,
and each range is sorted and written as one file: columns doc_id, shard, seq, shard_start,
n_tokens, ids. Readers of token counts touch only the small columns; readers of tokens can
skip row groups and pages by doc_id.

Encoding is the tokenizer's own. A byte-level pre-tokenizer starts a new piece at a single
blank or newline between two other characters, so such texts are cut there, each different
word of a batch is encoded once, and ids of words are kept for later batches. Texts with any
other white space or with an added token (such as `<|endoftext|>`) go to the tokenizer whole,
and so do all texts where the tokenizer's file says anything else of normalising or cutting.

Defined cases: null texts are empty; an empty text is the end id alone; repeated ids and
rows are documents of their own, in the order of their place in the input; null ids come
first; an empty table gives a file set without rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.common import new_path

END_ID = 0
ROW_GROUP_BYTES = 16 * 1024 * 1024
PAGE_BYTES = 256 * 1024
#: Different words, and pieces of words, whose ids a Python worker keeps; once full, a store takes no more.
KEPT_WORDS, KEPT_PIECES = 400_000, 200_000
#: Bytes of text encoded at once (one longer text is taken alone).
BATCH_BYTES = 3 << 20
#: Ids sampled for each range's bounds, and in all.
SAMPLE_EACH, SAMPLE_ALL = 100, 200_000
#: White space that is not one blank or newline between other characters (and what libraries may take for it).
UNCUT = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
# The byte-level pre-tokenizer's pattern, spelled out for characters up to U+024F (Unicode tables of two libraries agree on these).
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECE = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
UNUSUAL = re.compile("[^\x00-\u024f]")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}


class Pieces(dict):
    """Ids of pieces (as bytes) by the tokenizer's model, made when a piece first comes up and kept while there is room."""

    def __init__(self, model):
        self.tokenize, self.stand_ins = model.tokenize, byte_characters()

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [x.id for x in self.tokenize(piece.encode().decode("latin-1").translate(self.stand_ins))]).tobytes()
        if len(self) < KEPT_PIECES:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts by one tokenizer; kept per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        before = told.get("pre_tokenizer") or {}
        newline = self.whole("\n")
        plain = all(told.get(k) is None for k in ("normalizer", "truncation", "padding")) and told["model"].get("dropout") is None
        self.cuts = plain and before.get("type") == "ByteLevel" and before.get("add_prefix_space") is False and before.get("use_regex", True) and len(newline) == 1 and not re.search(r"\s", "".join(added))
        self.uncut = "|".join([UNCUT, *map(re.escape, added)])
        self.kept, self.pieces = pa.array(["\n"]), Pieces(self.tokenizer.model)
        self.ids, self.starts, self.sizes = newline[:1], np.zeros(1, np.int32), np.ones(1, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slot of each word, and ids, starts and sizes by slot. A word stands after a blank, or begins with its newline."""
        told = pc.index_in(words, value_set=self.kept)
        slots = np.array(told.fill_null(-1))
        new = np.flatnonzero(slots < 0)
        if not len(new):
            return slots, self.ids, self.starts, self.sizes
        fresh = words.take(pa.array(new)).dictionary_encode()
        slots[new] = len(self.kept) + np.asarray(fresh.indices)
        piece, texts = self.pieces.__getitem__, [w if w[0] == "\n" else f" {w}" for w in fresh.dictionary.to_pylist()]
        parts = [self.whole(t).tobytes() if UNUSUAL.search(t) else b"".join(map(piece, PIECE.findall(t))) for t in texts]
        found, made = np.frombuffer(b"".join(parts), np.uint32), np.array([len(x) // 4 for x in parts], np.int32)
        ids, starts, sizes = np.r_[self.ids, found], np.r_[self.starts, len(self.ids) + np.cumsum(made, dtype=np.int32) - made], np.r_[self.sizes, made]
        if len(self.kept) < KEPT_WORDS:
            self.kept = pa.concat_arrays([self.kept, fresh.dictionary[: KEPT_WORDS - len(self.kept)]])
            n = len(self.kept)
            self.starts, self.sizes = starts[:n], sizes[:n]
            self.ids = ids[: self.starts[-1] + self.sizes[-1]]
        return slots, ids, starts, sizes

    def cut(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by end, and where each begins and the last ends; single blanks and newlines alone."""
        lines = pc.binary_join_element_wise(pa.scalar("\n"), pc.replace_substring(texts, "\n", " \n"), pa.scalar(""))
        parts = pc.split_pattern(lines, " ")
        slots, ids, starts, sizes = self.words(parts.flatten())
        n = sizes[slots]
        at = np.r_[0, np.cumsum(n, dtype=np.int64)]
        every = ids[np.arange(at[-1]) + np.repeat(starts[slots] - at[:-1], n)]
        offsets = np.asarray(parts.offsets).astype(np.int64)
        edges = at[offsets - offsets[0]]
        # the newline put before each text moves behind it and becomes the end id
        out = np.r_[every[1:], every[:1]]
        if end:
            out[edges[1:] - 1] = end[0]
            return out, edges
        keep = np.ones(len(out), bool)
        keep[edges[1:] - 1] = False
        return out[keep], edges - np.arange(len(edges))

    def batch(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each text begins and the last ends."""
        end = [] if end_id is None else [end_id]
        texts = texts.fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, self.uncut)) if self.cuts else np.ones(len(texts), bool)
        if not odd.any():
            return self.cut(texts, end) if len(texts) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            ids, edges = self.cut(texts.take(pa.array(plain)), end)
            for i, a, z in zip(plain.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out[i] = ids[a:z]
        tail = np.array(end, np.uint32)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.r_[self.whole(texts[i].as_py()), tail]
        return np.concatenate(out).astype(np.uint32), np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)


@functools.cache
def of_file(path: str) -> Encoder:
    """The tokenizer of a file, once per Python worker."""
    return Encoder(path)


def encoder(path: str, end_id: int | None = END_ID) -> Callable[[str | None], bytes]:
    """A function from a text to its ids as little-endian 32-bit integers, the end id last."""
    return lambda text: of_file(path).batch(pa.array([text], pa.string()), end_id)[0].astype("<u4").tobytes()


def slices(texts: pa.Array, room: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `room` bytes of text (or one row)."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")))
        yield at, to
        at = to


def range_bounds(documents: DataFrame, id_col: str, ranges: int) -> list[tuple]:
    """At most ranges - 1 bounds (has an id, id, place) from a sample of bounded size; reads ids alone."""
    rows = documents.select(F.col(id_col).alias("i"), F.monotonically_increasing_id().alias("place"))
    share = min(SAMPLE_ALL, SAMPLE_EACH * ranges) / max(1, documents.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("place"), F.lit(1_000_003)) < int(share * 1_000_003))
    drawn = sorted((r["i"] is not None, 0 if r["i"] is None else r["i"], r["place"]) for r in rows.collect())
    return [drawn[k * len(drawn) // ranges] for k in range(1, ranges)] if len(drawn) >= ranges else drawn


def write(documents: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, ranges: int | None = None) -> None:
    """Encode every document and write the files in ascending id order; as many ranges as the input has splits."""
    kind = documents.schema[id_col].dataType
    ranges = ranges or max(1, documents.select(id_col, text_col).rdd.getNumPartitions())
    bounds = range_bounds(documents, id_col, ranges)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.col(text_col).alias("text"))
    kept = np.uint16 if of_file(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
    packed = T.StructType().add("doc_id", kind).add("place", T.LongType()).add("part", T.IntegerType()).add("ids", T.BinaryType())
    packed_arrow = to_arrow_schema(packed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = of_file(tokenizer_path)
        for batch in batches:
            for at, to in slices(batch.column(2)):
                doc, place, texts = (batch.column(k).slice(at, to - at) for k in range(3))
                ids, edges = one.batch(texts, end_id)
                part = [bisect_right(bounds, (i is not None, 0 if i is None else i, p)) for i, p in zip(doc.to_pylist(), place.to_pylist(), strict=True)]
                held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((edges * kept().itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kept))])
                yield pa.RecordBatch.from_arrays([doc, place, pa.array(part, pa.int32()), held], schema=packed_arrow)

    dealt = rows.mapInArrow(encode, packed).repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "doc_id", "place").select("doc_id", "part", "ids")
    files = T.StructType().add("doc_id", kind).add("shard", T.IntegerType()).add("seq", T.LongType()).add("shard_start", T.LongType()).add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))
    files_arrow = to_arrow_schema(files)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, start = -1, 0, 0
        for batch in batches:
            parts = np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if to == at:
                    continue
                if parts[at] != shard:
                    shard, seq, start = int(parts[at]), 0, 0
                held = batch.column(2).slice(at, to - at)
                edges = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // kept().itemsize
                ids = np.frombuffer(held.buffers()[2], kept, edges[-1])[edges[0] :].astype(np.int32) if edges[-1] > edges[0] else np.zeros(0, np.int32)
                n = np.diff(edges).astype(np.int64)
                starts = start + np.cumsum(n) - n
                values = pa.ListArray.from_arrays(pa.array(edges - edges[0]), pa.array(ids))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, to - at), pa.array(parts[at:to]), pa.array(seq + np.arange(to - at)), pa.array(starts), pa.array(n), values,
                ], schema=files_arrow)
                seq, start = seq + to - at, start + int(n.sum())

    dealt.mapInArrow(lists, files).write.options(**{
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES),
        "parquet.enable.dictionary": "true", "parquet.page.write-checksum.enabled": "true",
    }).parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Per shard: offset, the ids in all shards before it. Reads only the small columns; one row per shard."""
    totals = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return totals.select(F.col("shard").alias("of_shard"), (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("offset"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    kind = spark.read.parquet(path).schema["doc_id"].dataType.simpleString()

    files = spark.read.parquet(path).select("doc_id", "shard", "shard_start", "n_tokens", "ids")
    arrow_kind = files.select("doc_id", "shard", "shard_start", "n_tokens").schema.add("ids_crc32", "long").add("n_read", T.LongType())
    schema = to_arrow_schema(arrow_kind)

    def crc(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            offsets = np.asarray(ids.offsets)
            data = np.asarray(ids.values).astype("<u4").tobytes()
            sums = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            cols = [b.column(i) for i in range(4)] + [pa.array(sums, pa.int64()), pa.array(np.diff(offsets).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = files.mapInArrow(crc, arrow_kind)
    found = rows.join(F.broadcast(starts(spark, path)), F.col("shard") == F.col("of_shard"))
    return found.select(F.col("doc_id").cast(kind), (F.col("offset") + F.col("shard_start")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The token lists with each document's place in the whole sequence."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(starts(spark, path)), F.col("shard") == F.col("of_shard")).select("doc_id", (F.col("offset") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def encode_and_digest(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = new_path(documents.sparkSession, "tokens")
    write(documents, path, tokenizer_path, id_col, text_col)
    return digests(documents.sparkSession, path)
