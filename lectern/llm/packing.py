"""Packing token ids into windows by multiway differencing.

Documents are encoded where they lie. What fills a window alone becomes one; the rests are
gathered in groups of bounded size, and each group is divided among windows by the largest
differencing method (Karmarkar and Karp): the two partial partitions with the largest
imbalance are merged, the fullest window of one with the emptiest of the other, until one
partition into near-equal windows is left. If a window exceeds the capacity, the number of
windows rises. Then the lightest windows are cut to fill the others, so that a window is
either full or the last of its group; that one is carried on to the next group, and the last
of a task is cut at powers of two, lengths that need no padding.

Defined cases: a null text is empty; an empty text is the end id alone; repeated rows and ids
are documents of their own; a null id is kept; extra columns are ignored; an empty table gives
no rows. The windows depend on how the input is split into tasks; a task done again packs alike.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import os
import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.tokens import LETTERS, NUMBERS, SPACES, Pieces, slices

#: Ids of a window.
CAPACITY = 4096
#: The id at the end of each document.
END_ID = 2
#: Ids of a group of rests, in windows.
GROUP_WINDOWS = 256
# Fixed value: the pattern of a pre-tokenizer whose pieces are found here for words of Latin letters up to U+017F.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE_OR_END = re.compile(PIECES.replace("\\p{L}", LETTERS).replace("\\p{N}", NUMBERS).replace("\\s", SPACES) + "|\n")
#: Other characters, and the one whose lower case is two.
ODD = r"[^\x00-\x{12f}\x{131}-\x{17f}]"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, by Karmarkar-Karp differencing of k-way partitions.

    A partition is its windows' sums above the smallest, largest first, and a node for each window; windows
    that hold nothing yet are left out. Merged windows become new nodes above the old ones.
    """
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    nodes, merged, ages = len(sizes), [], count(len(sizes))
    while len(heap) > 1:
        (_, _, a, a_nodes), (_, _, b, b_nodes) = heapq.heappop(heap), heapq.heappop(heap)
        short = k - len(a) - len(b)
        if short >= 0:
            sums, slots = np.concatenate((a, b)), np.concatenate((a_nodes, b_nodes))
        else:
            # the last of a meet the last of b, in opposite order
            alone_a, alone_b = len(a) + short, len(b) + short
            left, right = a_nodes[alone_a:], b_nodes[alone_b:][::-1]
            new = np.arange(nodes, nodes + len(left))
            merged.append((new, left, right))
            nodes += len(left)
            sums, slots = np.concatenate((a[:alone_a], b[:alone_b], a[alone_a:] + b[alone_b:][::-1])), np.concatenate((a_nodes[:alone_a], b_nodes[:alone_b], new))
        order = (-sums).argsort(kind="stable")
        sums, slots = sums[order], slots[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), next(ages), sums, slots))
    window = np.zeros(nodes, np.int64)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for new, left, right in reversed(merged):
        window[left] = window[right] = window[new]
    return window[: len(sizes)]


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Items by window: as few windows as hold all, more while one exceeds the capacity: as many as would bring the mean as
    far under it as the fullest lies over the mean, and at least one, two, four ... more."""
    total = int(sizes.sum())
    k, step = max(1, -(-total // capacity)), 1
    while True:
        at = differencing(sizes, k)
        fullest = int(np.bincount(at, sizes, k).max(initial=0))
        if fullest <= capacity:
            break
        over = fullest - total / k
        k, step = min(max(k + step, math.ceil(total / (capacity - over)) if over < capacity else 0), len(sizes)), step * 2
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(at, minlength=k))[:-1])]


def levelled(parts: list[list[tuple[int, int, int]]], capacity: int = CAPACITY) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length), each full, and the pieces left over (less than a window): the lightest
    windows are cut to fill the heaviest."""
    weigh = lambda pieces: sum(n for _, _, n in pieces)
    parts = sorted((list(p) for p in parts), key=weigh, reverse=True)
    i, j = 0, len(parts) - 1
    while i < j:
        room = capacity - weigh(parts[i])
        while room and i < j:
            if not parts[j]:
                j -= 1
                continue
            item, start, n = parts[j].pop()
            if n > room:
                parts[j].append((item, start, n - room))
                start, n = start + n - room, room
            parts[i].append((item, start, n))
            room -= n
        i += not room
    last = parts[j] if parts else []
    full = parts[:j]
    return ([*full, last], []) if weigh(last) == capacity else (full, last)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into windows whose lengths are the powers of two of their sum, largest first."""
    left, out = sum(n for _, _, n in pieces), []
    rest = list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            item, start, n = rest.pop()
            if n > room:
                rest.append((item, start + room, n - room))
                n = room
            out[-1].append((item, start, n))
            room -= n
    return out


class WordEncoder:
    """Ids of texts by one tokenizer. Where its file drops white space and joins nothing across it, texts are cut at
    ASCII white space and each different word is encoded once; texts with an added token go to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.cuts = self.apart(told)
        before = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_piece = self.cuts and len(before) == 2 and before[0]["pattern"] == {"Regex": PIECES}
        self.pieces = Pieces(self.tokenizer.model)
        self.pieces["\n"] = b""

    @staticmethod
    def apart(told: dict) -> bool:
        """Whether words between ASCII white space are encoded independently, by the tokenizer's file."""
        listed = lambda step, name: (step or {}).get(name, [step] if step else [])
        normal = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in listed(told.get("normalizer"), "normalizers"))
        before = listed(told.get("pre_tokenizer"), "pretokenizers")
        cut = before[0] if before else {}
        pattern = (cut.get("pattern") or {}).get("Regex", " ")
        removed = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and " " not in pattern and "\\s" not in pattern.replace("[^\\s", "")
        rest = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in before[1:])
        return bool(normal and removed and rest and told.get("truncation") is None and told.get("padding") is None and told["model"].get("dropout") is None)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, plain ones first, and where each word's begin and how many they are.

        Plain Latin words have nothing to compose and are lower-cased by character; they are cut into pieces all at once.
        """
        odd = np.asarray(pc.match_substring_regex(words, ODD)) if self.by_piece else np.ones(len(words), bool)
        plain = words.filter(pa.array(~odd)).to_pylist()
        parts = list(map(self.pieces.__getitem__, PIECE_OR_END.findall("\n".join([*plain, ""]).lower())))
        at = np.cumsum(np.r_[0, np.fromiter(map(len, parts), np.int64, len(parts)) // 4])
        # only the end of a word has no ids
        edges = np.r_[0, at[1:][np.diff(at) == 0]]
        rest = [self.whole(w) for w in words.filter(pa.array(odd)).to_pylist()]
        sizes, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[~odd], starts[~odd] = np.diff(edges), edges[:-1]
        n = np.array([len(x) for x in rest], np.int64)
        sizes[odd], starts[odd] = n, at[-1] + np.cumsum(n) - n
        return np.concatenate([np.frombuffer(b"".join(parts), np.uint32), *rest]), starts, sizes

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = texts.fill_null("")
        odd = np.zeros(len(texts), bool) if self.cuts else np.ones(len(texts), bool)
        for token in self.added:
            odd |= np.asarray(pc.match_substring(texts, token))
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            parts = pc.ascii_split_whitespace(texts.take(pa.array(plain)))
            told = parts.flatten().dictionary_encode()
            every, starts, sizes = self.words(told.dictionary)
            slots = np.asarray(told.indices)
            n = sizes[slots]
            at = np.r_[0, np.cumsum(n)]
            flat = every[np.arange(at[-1]) + np.repeat(starts[slots] - at[:-1], n)]
            offsets = np.asarray(parts.offsets).astype(np.int64)
            edges = at[offsets - offsets[0]].tolist()
            for k, i in enumerate(plain.tolist()):
                out[i] = flat[edges[k] : edges[k + 1]]
        return out


@functools.cache
def of_file(path: str) -> WordEncoder:
    """The tokenizer of a file, once per Python worker."""
    return WordEncoder(path)


def pack(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Per piece of a document: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset (in
    the sequence) and ids (little-endian unsigned 32-bit integers). Rows come sequence by sequence."""
    schema = T.StructType().add("doc_id", documents.schema[id_col].dataType)
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    schema = schema.add("ids", "binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_file(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 33
        # rests of documents: (id, ids of the document before the rest, all ids of the document, the rest's ids)
        items: list[tuple[object, int, int, np.ndarray]] = []
        held = 0
        rows: list[tuple] = []

        def put(pieces: list[tuple[int, int, int]], of: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for item, start, n in pieces:
                id_, before, total, ids = of[item]
                rows.append((id_, before + start, n, total, sequence, offset, ids[start : start + n].tobytes()))
                offset += n
            sequence += 1

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            rows.clear()
            return out

        def close(last: bool) -> None:
            nonlocal items, held
            sizes = np.array([len(x[3]) for x in items], np.int64)
            full, left = levelled([[(i, 0, int(sizes[i])) for i in w] for w in windows(sizes, capacity)], capacity)
            for pieces in [*full, *(powers(left) if last else [])]:
                put(pieces, items)
            items = [(items[i][0], items[i][1] + s, items[i][2], items[i][3][s : s + n].copy()) for i, s, n in ([] if last else left)]
            held = sum(len(x[3]) for x in items)

        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                for id_, found in zip(part.column(0).to_pylist(), encoder.batch(part.column(1)), strict=True):
                    ids = np.r_[found, np.uint32(end_id)].astype("<u4")
                    whole = len(ids) - len(ids) % capacity
                    for start in range(0, whole, capacity):
                        put([(0, start, capacity)], [(id_, 0, len(ids), ids)])
                    if whole < len(ids):
                        items.append((id_, whole, len(ids), ids[whole:]))
                        held += len(ids) - whole
                    if held >= group_windows * capacity:
                        close(False)
                    if len(rows) >= 4096:
                        yield given()
        if items:
            close(True)
        if rows:
            yield given()

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Per sequence: sequence_id, n_tokens, ids (array, padded to the capacity unless their number is a power of two) and
    lengths of its pieces in order. A sequence has at most `capacity` pieces."""
    schema = T.StructType().add("sequence_id", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.LongType())).add("lengths", T.ArrayType(T.LongType()))
    arrow = to_arrow_schema(schema)
    met = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sequence, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).astype(np.int64)
                n = len(ids)
                padded = ids if n & (n - 1) == 0 else np.r_[ids, np.full(capacity - n, pad_id)]
                out.append((sequence, n, padded, [p["length"] for p in pieces]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return met.mapInArrow(run, schema)


def digest(packed: DataFrame) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
