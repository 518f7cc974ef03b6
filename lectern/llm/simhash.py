"""SimHash near-duplicates by bit-sliced comparison.

Rows of a key are compared bit-sliced: fingerprints are stored 64 at a time as vertical bit
planes, a query's bits are XORed against the planes, and carry-save counter bits with a
sticky overflow count the differences of all 64 at once; a block is abandoned when every
member is beyond the radius. A key's links go out as a star on its smallest member, so
links grow with rows, not with pairs. Keys with more than `CHUNK` fingerprints are cut into
chunks which meet pair by pair, each pair of chunks in a group of its own.

`near_duplicates` is exact for 64 bits and `RADIUS`: fingerprints within three bits agree in
one of four 16-bit blocks, and then in one of four 12-bit parts of the other 48 bits, so 16
keys of 28 bits bring every close pair together.

`deduplicated` links texts whose sets of distinct word five-grams have a Jaccard similarity
of `SIMILAR` or more. Each set has a fingerprint of 128 bits. Keys of `BANDS` bands of
`BAND_ROWS` MinHash values bring sets together (a pair at 0.8 is missed with probability
(1 - 0.8 ** 6) ** 36 = 0.00002; keys of a fingerprint's own bits would hold ever more rows as
a table grows). The bit-sliced comparison links the members of a key within `WIDE_RADIUS`:
at 0.8 a bit differs with probability 0.15, at most 0.19 for sets of a few shingles, so the
radius is 4.6 standard deviations beyond. What such links join is a group of candidates; each
set then meets the others of its group once, and pairs whose counted similarity is enough
are linked. Groups of more than `SET_CHUNK` sets are cut into chunks which meet pair by pair.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other;
one or two words are one shingle; equal rows share a component; null ids belong to a
component but never name it unless no other does; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.llm.common import Scratch, map_rows, stored

SHINGLE = 3
SEED = 42
RADIUS = 3
#: `deduplicated`: words of a shingle, similarity, bands and MinHash values of a band, and sets of a group in a chunk.
WIDE_SHINGLE, SIMILAR, BANDS, BAND_ROWS, SET_CHUNK = 5, 0.8, 36, 6, 512
#: 64-bit words of its fingerprints, and bits by which linked ones differ at most.
WIDE, WIDE_RADIUS = 2, 44
#: A key with more rows than this, and than one of HUBS parts of all, is joined by broadcast: there are at most HUBS of them.
HUB_ROWS, HUBS = 2000, 50_000
#: Shingles (columns) that the sets of a group are compared by at once.
COLUMNS = 4096
#: Fingerprints of one key that are compared in one group.
CHUNK = 16_384
#: Rows of small groups gathered for one vectorised pass.
PASS_ROWS = 65_536
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: Iterator[np.ndarray], wide: int = 1) -> list[int]:
    """64-bit words in which a bit is 1 if over half the hashes have it; further words are of hashes mixed again."""
    ones, n = np.zeros((wide, 64), np.int64), 0
    for h in hashes:
        n += len(h)
        for w in range(wide):
            ones[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            if w + 1 < wide:
                h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats counted."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < size else [b" ".join(g) for g in zip(*(words[i:] for i in range(size)), strict=False)]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, SEED) for g in grams[at : at + 8192]], "<u8") for at in range(0, len(grams), 8192))[0]


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp: the fingerprint as a signed long."""
    kind = documents.schema[id_col].dataType.simpleString()

    def make() -> Callable:
        return lambda cols: {"doc_id": cols["doc_id"], "fp": pa.array(np.array([fingerprint(t, size) for t in cols["text"]], np.uint64).view(np.int64))}

    return map_rows(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, fp long")


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words) of fingerprints (n, wide), 64 to a word; n is a multiple of 64."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """For each (word of 64 members, query fingerprint, mask of members asked for): a mask of those within the radius."""
    out = np.zeros(len(words), np.uint64)
    alive, bits = np.arange(len(words)), len(planes)
    beyond = ~asked
    digits = [np.zeros(len(words), np.uint64) for _ in range(radius.bit_length())]
    step = 8 if bits <= 64 else 16
    for bit in range(bits):
        carry = planes[bit][words] ^ (np.uint64(0) - ((queries[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)))
        for d in digits:
            held = d & carry
            d ^= carry
            carry = held
        beyond |= carry
        if bit + 1 == bits or bit >= radius and bit % step == step - 1:
            more, same = np.zeros_like(beyond), np.full_like(beyond, ALL)
            for k in range(len(digits) - 1, -1, -1):
                if radius >> k & 1:
                    same &= digits[k]
                else:
                    more |= same & digits[k]
                    same &= ~digits[k]
            keep = (beyond | more) != ALL
            if bit + 1 == bits:
                out[alive] = ~(beyond | more)
            elif not keep.all():
                alive, words, queries, beyond = alive[keep], words[keep], queries[keep], beyond[keep]
                digits = [d[keep] for d in digits]
                if not len(alive):
                    break
    return out


def links(key: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each place the first place of its connected group, within runs of equal key; fp has a row per place.

    side 0: all members meet each other; sides 1 and 2: members of side 1 meet those of side 2.
    """
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], n]
    of = np.repeat(np.arange(len(starts)), ends - starts)
    room = np.zeros((-(-n // 64) * 64, fp.shape[1]), np.uint64)
    room[:n] = fp
    planes = _planes(room)
    real = np.zeros(len(room), bool)
    real[:n] = side != 1
    valid = np.packbits(real.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    label = np.arange(n)
    asks = np.flatnonzero((side != 2) & ((ends - starts)[of] > 1))
    low, high = starts[of[asks]], ends[of[asks]]
    n_words = (high - 1) // 64 - low // 64 + 1
    cut, at = np.cumsum(n_words), 0
    pairs_a: list[np.ndarray] = []
    pairs_b: list[np.ndarray] = []
    while at < len(asks):  # bounded batches of (query, word)
        to = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + 300_000, "right")))
        q = np.repeat(np.arange(at, to), n_words[at:to])
        first = np.cumsum(n_words[at:to]) - n_words[at:to]
        word = (low // 64)[q] + np.arange(len(q)) - np.repeat(first, n_words[at:to])
        begin, end = np.maximum(low[q] - word * 64, 0), np.minimum(high[q] - word * 64, 64)
        mask = (ALL >> (64 - (end - begin)).astype(np.uint64)) << begin.astype(np.uint64)
        found = close(planes, word, fp[asks[q]], mask & valid[word], radius)
        hit = np.flatnonzero(found)
        if len(hit):
            row, col = np.nonzero(np.unpackbits(found[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = asks[q[hit[row]]], word[hit[row]] * 64 + col
            pairs_a.append(a[a != b])
            pairs_b.append(b[a != b])
        at = to
        if pairs_a and (sum(map(len, pairs_a)) > 2_000_000 or at >= len(asks)):
            label = _components(label, np.concatenate(pairs_a), np.concatenate(pairs_b))
            pairs_a, pairs_b = [], []
    return label


def _components(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable label of each place over the links a-b."""
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _keys(fp: str = "fp") -> list:
    """16 (table, key) structs: a 16-bit block and a 12-bit part of the other 48 bits."""
    out = []
    for block in range(4):
        head = f"(shiftrightunsigned({fp}, {16 * block}) & 65535L)"
        low = f"({fp} & {(1 << 16 * block) - 1}L)"
        high = "0L" if block == 3 else f"shiftrightunsigned({fp}, {16 * block + 16})"
        rest = f"({low} | shiftleft({high}, {16 * block}))"
        out += [f"named_struct('key', shiftleft({head}, 16) | {4 * block + part}L | shiftleft(shiftrightunsigned({rest}, {12 * part}) & 4095L, 4))" for part in range(4)]
    return out


def met(keyed: DataFrame, counts: DataFrame, chunk: int) -> DataFrame:
    """keyed with lo, hi and side: the chunks of its key that a row meets; counts (key, count) holds the keys' rows."""
    hot = stored(counts.where(F.col("count") > chunk).select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "hot-keys")
    rows = keyed.join(F.broadcast(hot) if hot.count() <= 10_000 else hot, F.col("key") == F.col("hot_key"), "left")
    mine = F.pmod(F.xxhash64("node"), F.coalesce(F.col("chunks"), F.lit(1))).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1), lambda o: F.struct(
        F.least(mine, o).alias("lo"), F.greatest(mine, o).alias("hi"), F.when(mine == o, 0).when(mine < o, 1).otherwise(2).alias("side")))
    return rows.select(*keyed.columns, F.inline(meets))


def close_keys(distinct: DataFrame) -> DataFrame:
    """key, node and fp for each of the 16 keys of 28 bits, of which two fingerprints within `RADIUS` share one."""
    return distinct.select(F.expr(f"inline(array({', '.join(_keys())}))"), F.col("fp").alias("node"), "fp")


def candidate_links(keyed: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between nodes whose transitive closure joins all that a key brings within the radius.

    keyed: key, node and the words of the fingerprint, a row for each key of a node.
    """
    words = keyed.columns[2:]
    rows = met(keyed, keyed.groupBy("key").count(), chunk)
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", low("node")).select("key", "lo", "hi", "side", "node", *words)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            whole = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            group = np.repeat(np.arange(len(whole)), np.diff(np.r_[whole, len(rows)]))
            many = np.bincount(group)[group] > 1
            rows, group = rows[many], group[many]
            label = links(group, np.ascontiguousarray(rows[:, 5:]).view(np.uint64), rows[:, 3], radius) if len(rows) else np.zeros(0, np.int64)
            moved = np.flatnonzero(label != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(rows[moved, 4]), pa.array(rows[label[moved], 4])], schema=schema)

        for batch in batches:
            held.append(np.column_stack([np.asarray(c).astype(np.int64) for c in batch.columns]))
            size += len(held[-1])
            if size >= PASS_ROWS:
                rows = np.concatenate(held)
                cut = int(np.argmax((rows[:, :3] == rows[-1, :3]).all(axis=1)))
                if cut:
                    yield flush(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield flush(np.concatenate(held))

    return rows.mapInArrow(compare, "a long, b long").distinct()


def hub_join(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """rows joined with the one row that least (with column n, rows of the key) has for each key. Keys of very many rows
    do not meet in one task: there are few of them, so they are broadcast and their rows stay where they are."""
    total, most = least.agg(F.sum("n"), F.max("n")).first()
    limit = max(HUB_ROWS, (total or 0) // HUBS)
    if (most or 0) <= limit:
        return rows.join(least.drop("n"), key)
    hubs = least.where(F.col("n") > limit).drop("n")
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(least.where(F.col("n") <= limit).drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(hubs), key))


def low(c: str) -> Column:
    """Unsigned order as signed order."""
    return F.col(c).bitwiseXOR(F.lit(-(1 << 63)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots: root is the smallest unsigned node reachable.

    Alternates large-star and small-star steps; each step is written, so none is recomputed, and what it follows is deleted.
    """
    scratch = Scratch(edges.sparkSession)
    links_ = scratch.stored(edges.select(low("a").alias("a"), low("b").alias("b")).where("a <> b").distinct(), "links")
    told = lambda: tuple(links_.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = told()
    while True:
        both = links_.unionByName(links_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = hub_join(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = scratch.stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
        least = scratch.stored(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = hub_join(down, least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        links_ = scratch.stored(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), "links")
        now = told()
        scratch.keep_last()
        if now == before:
            return links_.select(low("a").alias("node"), low("b").alias("root"))
        before = now


def labelled(docs: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """docs (doc_id, node) with component_id: the smallest doc_id that links reach, itself included; distinct has node, least_id and n (rows)."""
    roots = components(edges).withColumnRenamed("node", "linked")
    named = stored(distinct.join(roots, F.col("node") == F.col("linked"), "left").select("node", "least_id", F.coalesce("root", "node").alias("root"), F.col("n").alias("of_node")), "named")
    lowest = stored(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "lowest")
    labels = stored(hub_join(named.select("node", "of_node", "root"), lowest, "root").select("node", "component_id", F.col("of_node").alias("n")), "labels")
    return hub_join(docs, labels, "node")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included)."""
    docs = stored(fingerprints(documents, id_col, text_col, size), "fingerprints")
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")).withColumn("node", F.col("fp")), "distinct")
    found = labelled(docs.withColumn("node", F.col("fp")), distinct, candidate_links(close_keys(distinct)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, size: int = WIDE_SHINGLE) -> np.ndarray:
    """Hashes of the text's distinct word shingles in ascending order; none for a text without words."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    grams = {b" ".join(words)} if len(words) < size else {b" ".join(g) for g in zip(*(words[i:] for i in range(size)), strict=False)}
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each of `BANDS` bands of `BAND_ROWS` least values under random orders: sets of similarity s share
    a band's key with probability s ** BAND_ROWS, however large they are."""
    draw = np.random.default_rng(SEED).integers(0, 2**32, (2, BANDS * BAND_ROWS), dtype=np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(hashes), 256):  # small enough for the processor's cache
        least = np.minimum(least, ((short[at : at + 256] ^ draw[0]) * (draw[1] | np.uint32(1))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def shingle_sets(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, text, place (of the row), node (a hash of its set of shingles), fp0, fp1 (its fingerprint) and keys (of the set's bands)."""
    kind = documents.schema[id_col].dataType.simpleString()

    def make() -> Callable:
        def step(cols: dict) -> dict:
            sets = [shingles(t, size) for t in cols["text"]]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
            keys = [band_keys(x) if len(x) else x for x in sets]
            fp = np.array([majority((x[at : at + 8192] for at in range(0, len(x), 8192)), WIDE) for x in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            words = {f"fp{k}": pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WIDE)}
            return {n: cols[n] for n in ("doc_id", "text", "place")} | {"node": pa.array(nodes.view(np.int64)), "keys": _lists(keys)} | words

        return step

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    return map_rows(rows, make, f"doc_id {kind}, text string, place long, node long, {', '.join(f'fp{k} long' for k in range(WIDE))}, keys array<long>", rows=256)


def set_links(sets: list[np.ndarray], side: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """For each set the first place of its connected group: sets are linked if their Jaccard similarity is `least` or more. Sides as in `links`."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(n), sizes), often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((n, int(column[z - 1]) + 1 - at), np.float32)
        held[row[a:z], column[a:z] - at] = 1
        both += held @ held.T
    linked = both >= least * (sizes[:, None] + sizes - both) - 1e-6
    linked &= (side[:, None] == 0) | (side[:, None] != side)
    a, b = np.nonzero(np.triu(linked, 1))
    return _components(np.arange(n), a, b)


def close_links(docs: DataFrame, distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join all sets which share a band's key and have close fingerprints: candidates."""
    one = docs.select("place", "node", *[f"fp{k}" for k in range(WIDE)], "keys").join(distinct.select("place"), "place", "left_semi")
    keyed = stored(one.select(F.explode("keys").alias("key"), "node", *[f"fp{k}" for k in range(WIDE)]), "keyed")
    return candidate_links(keyed, WIDE_RADIUS, chunk)


def similar_links(docs: DataFrame, distinct: DataFrame, candidates: DataFrame, size: int = WIDE_SHINGLE, least: float = SIMILAR, chunk: int = SET_CHUNK) -> DataFrame:
    """Links (a, b) whose transitive closure joins all nodes of a group of candidates (node, root) with similar sets.

    distinct holds each node once with the place of a row of docs; only texts of groups of two nodes or more travel.
    """
    members = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct()).select("node", F.col("root").alias("key"))
    members = stored(members.join(distinct.select("node", "place"), "node"), "members")
    rows = met(members, members.groupBy("key").count(), chunk)
    asked = rows.groupBy("place").agg(F.collect_list(F.struct("key", "lo", "hi", "side")).alias("asked"))
    texts = docs.select("place", "node", "text").join(asked, "place").select("node", "text", "asked")

    def make() -> Callable:
        return lambda cols: {"node": cols["node"], "asked": cols["asked"], "grams": _lists([shingles(t, size) for t in cols["text"]])}

    rows = map_rows(texts, make, "node long, asked array<struct<key: long, lo: int, hi: int, side: int>>, grams array<long>", rows=256).select(F.inline("asked"), "node", "grams")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", low("node")).select("key", "lo", "hi", "side", "node", "grams")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        side: list[int] = []
        node: list[int] = []
        sets: list[np.ndarray] = []
        a: list[int] = []
        b: list[int] = []

        def flush() -> None:
            if len(sets) > 1:
                label = set_links(sets, np.array(side), least)
                moved = np.flatnonzero(label != np.arange(len(label)))
                a.extend(node[i] for i in moved)
                b.extend(node[i] for i in label[moved])
            for held in (side, node, sets):
                held.clear()

        for batch in batches:
            grams = batch.column(5)
            ends, values = np.asarray(grams.offsets), np.asarray(grams.values)
            for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if row[:3] != group:
                    flush()
                    group = row[:3]
                side.append(row[3])
                node.append(row[4])
                sets.append(values[ends[i] : ends[i + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
            a.clear()
            b.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WIDE_SHINGLE) -> DataFrame:
    """The documents, all columns, of which each group of near copies (Jaccard similarity of the distinct word shingles
    `SIMILAR` or more, and what such links join) keeps one row: that of its smallest id (of rows that share it, the one of
    the smallest text). Rows without an id cannot be named, so of these each different text stays once."""
    docs = stored(shingle_sets(documents, id_col, text_col, size), "shingle-sets", compression="zstd")
    distinct = stored(docs.groupBy("node").agg(F.min("place").alias("place"), F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct")
    candidates = components(close_links(docs, distinct))
    found = labelled(docs.select("doc_id", "node"), distinct, similar_links(docs, distinct, candidates, size))
    keep = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_keep_id")).distinct()
    rows = documents.join(keep, F.col(id_col).eqNullSafe(F.col("_keep_id")), "left_semi")
    order = W.partitionBy(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))).orderBy(F.col(text_col).asc_nulls_last())
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
