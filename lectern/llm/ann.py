"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are lengthened by one component so that the largest inner product becomes the least
distance, then rotated by a fixed random rotation: any leading block of rotated components
is a random projection. Lists are the cells of centroids fitted on a bounded sample; every
distinct vector is in exactly one list, and big lists are cut into shards, and their queries
into blocks, that are searched side by side. Within a list, a query reads one block of
components after another and abandons candidates whose partial distance, scaled up, exceeds
its k-th best by more than chance allows (a one-sided test); once few pairs are left they are
followed one by one. A query first visits the lists nearest to it; the k-th best score found
there goes with it to the others, and a query that still lacks answers visits all lists. How
many lists a query visits is measured on the sample. Survivors are scored exactly on the
original vectors in double precision.

Equal vectors are indexed once, with the smallest ids that can ever be in an answer (k + 1
different ones, and how often each occurs); a query's own rows go before an answer is cut; equal queries are searched once.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or
differ in length from most (of equally many the longest), take no part; ties go to the smaller id; repeated rows
are candidates of their own (rows with the query's id are its own); null ids take no part;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.llm.common import stored

#: Neighbours of a query.
K = 20
#: Distinct vectors of a list and of a shard, on average.
LIST_ROWS, SHARD_ROWS = 1000, 4000
#: Centroids at most; lists of larger tables grow and are sharded.
MOST_LISTS = 4096
#: Rows the centroids are fitted on, and components of them all, at most.
SAMPLE_ROWS, SAMPLE_COMPONENTS = 40_000, 8_000_000
#: Recall to aim at, queries of the sample that show how many lists it takes, lists at least and of the first visit.
TARGET, CALIBRATION, LEAST_PROBES, FIRST_PROBES = 0.96, 400, 8, 4
#: Queries scanned together, and queries of a list in a block, on average.
TOGETHER, QUERY_ROWS = 256, 4000
#: Components of a column block, the factor of the test (larger abandons less), and the share of pairs left from which they are followed one by one.
BLOCK, EPSILON, SPARSE = 16, 2.1, 0.1
SEED = 7


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centre, 1)[:, 0]
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest centroids of each row, nearest first."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 2048):
        d = (centre**2).sum(axis=1) - 2 * (x[at : at + 2048] @ centre.T)
        out[at : at + 2048] = np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def adaptive_scan(rows: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the indices of rows (both rotated) that the tests leave over for its k nearest.

    One block of components after another adds to the partial distances; a pair whose scaled
    distance fails the test is abandoned: rows that no query needs leave the later blocks, and
    few pairs go on alone. known: for each query a squared distance beyond which no row matters.
    """
    n, d = rows.shape
    none = known is None or not np.isfinite(known).any()
    if n <= k and none:
        return [np.arange(n)] * len(queries)
    rounding = 1e-5 * ((rows**2).sum(axis=1).max() + (queries**2).sum(axis=1)) + 1e-4
    limit = np.full(len(queries), np.inf) if known is None else known.astype(float)
    at_row = np.arange(n)
    partial = np.zeros((len(queries), n), np.float32)
    alive, sure = np.ones_like(partial, bool), np.zeros_like(partial, bool)
    done = 0
    while done < d:
        x, q = rows[at_row, done : done + BLOCK], queries[:, done : done + BLOCK]
        partial += (x**2).sum(axis=1) + (q**2).sum(axis=1)[:, None] - 2 * (q @ x.T)
        first, done = done == 0, min(d, done + BLOCK)
        if first and n > k:  # the whole distance of the k most promising bounds the k-th best
            best = np.argpartition(partial, k - 1, axis=1)[:, :k]
            limit = np.minimum(limit, [((rows[f] - one) ** 2).sum(axis=1).max() for f, one in zip(best, queries, strict=True)])
            np.put_along_axis(sure, best, True, axis=1)  # they stay, so that every query keeps k rows
        slack = (1 + EPSILON / np.sqrt(done)) ** 2 * done / d if done < d else 1.0
        alive &= sure | (partial <= (limit * slack + rounding)[:, None])
        if done < d and alive.mean() < SPARSE:
            break
        keep = alive.any(axis=0)
        if keep.mean() < 0.8:
            at_row, partial, alive, sure = at_row[keep], partial[:, keep], alive[:, keep], sure[:, keep]
    one, row = np.nonzero(alive)
    far, stay, row = partial[one, row].astype(float), sure[one, row], at_row[row]
    while done < d:
        far += ((rows[row, done : done + BLOCK] - queries[one, done : done + BLOCK]) ** 2).sum(axis=1)
        done = min(d, done + BLOCK)
        slack = (1 + EPSILON / np.sqrt(done)) ** 2 * done / d if done < d else 1.0
        keep = stay | (far <= limit[one] * slack + rounding[one])
        one, row, far, stay = one[keep], row[keep], far[keep], stay[keep]
    # distances are whole now: only what rounding cannot tell from the k-th best stays
    order = np.lexsort((far, one))
    one, row, far = one[order], row[order], far[order]
    begin = np.searchsorted(one, np.arange(len(queries) + 1))
    out = []
    for i, (a, z) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
        z = min(z, a + np.searchsorted(far[a:z], (far[a + k - 1] if z - a >= k else np.inf) + rounding[i], "right"))
        out.append(np.sort(row[a:z]))
    return out


def probes_needed(sample: np.ndarray, tails: np.ndarray, turn: np.ndarray, centre: np.ndarray, k: int, target: float) -> int:
    """Lists a query must visit so that `target` of the sample's true neighbours lie in them: how well lists separate
    vectors depends on the data, so it is measured on the sample (whose neighbours are further away than the table's)."""
    asks = sample[:: max(1, len(sample) // CALIBRATION)][:CALIBRATION]
    own = nearest(np.c_[sample, tails] @ turn, centre, 1)[:, 0]
    order = nearest(np.c_[asks, np.zeros(len(asks))] @ turn, centre, len(centre))
    place = np.argsort(order, axis=1)
    ranks = []
    for q, p in zip(asks, place, strict=True):
        best = np.argsort(-(sample @ q), kind="stable")[: k + 1]
        ranks.append(p[own[best]])
    return int(np.quantile(np.concatenate(ranks), target, method="higher")) + 1 if ranks else 1


def enough(entries: list[tuple[float, int, int]], k: int) -> list[tuple[float, int]]:
    """(score, id) of sorted (score, id, count), so many that k are left without any one id."""
    out: list[tuple[float, int]] = []
    times: dict[int, int] = {}
    for s, i, n in entries:
        if len(out) - max(times.values(), default=0) >= k:
            break
        out += [(s, i)] * n
        times[i] = times.get(i, 0) + n
    return out


def search(vectors: DataFrame, query_rows: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
           target: float = TARGET, least_probes: int = LEAST_PROBES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best found for each row that query_rows selects."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), query_rows.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    width = lengths["width"]
    rows = stored(rows.where(F.size("v") == width).withColumn("vkey", F.sha2(F.to_json("v"), 256)), "ann-rows")
    # equal vectors once, with the ids that answers can need; the rank limit is applied before the shuffle too
    each = rows.groupBy("vkey", "vec_id").agg(F.first("v").alias("v"), F.least(F.count("*"), F.lit(k)).alias("n"))
    ranked = each.withColumn("nth", F.row_number().over(W.partitionBy("vkey").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    index = stored(ranked.groupBy("vkey").agg(F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct(F.col("vec_id").alias("i"), "n"))).alias("ids")), "ann-index")
    own = rows.where("asks").select("vec_id").distinct().join(rows.select("vec_id", "vkey").distinct(), "vec_id").groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1  # vectors of one query's id
    n, longest = index.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    lists = int(min(MOST_LISTS, max(1, n // LIST_ROWS)))
    turn = rotation(width + 1)
    most = max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // width))
    share = min(1.0, 1.2 * most / n)
    drawn = index.where(F.pmod(F.xxhash64("vkey"), F.lit(1_000_003)) <= int(share * 1_000_003)).limit(most).select("vkey", "v").toArrow().sort_by("vkey")
    sample = drawn.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width) if len(drawn) else np.zeros((0, width))
    tails = np.sqrt(np.maximum(0, longest - (sample**2).sum(axis=1)))
    centre = kmeans(np.c_[sample, tails] @ turn, min(lists, len(sample))) if len(sample) else np.zeros((1, width + 1))
    probes = min(len(centre), max(least_probes, probes_needed(sample, tails, turn, centre, k, target)))
    sent = spark.sparkContext.broadcast((turn, centre))  # at most MOST_LISTS centroids

    def placer(count: int, lengthen: bool) -> Callable:
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            turn_, centre_ = sent.value
            for v in batches:
                x = np.array(v.tolist(), float).reshape(-1, width)
                tail = np.sqrt(np.maximum(0, longest - (x**2).sum(axis=1))) if lengthen else np.zeros(len(x))
                found = nearest(np.c_[x, tail] @ turn_, centre_, count)
                yield pd.Series(list(found))

        return F.pandas_udf(place, "array<int>")

    placed = stored(index.withColumn("list", placer(1, True)(F.col("v"))[0]), "ann-lists")
    sizes = placed.groupBy("list").count().select(F.col("list").alias("of"), F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("shards"))
    sizes = F.broadcast(stored(sizes, "ann-sizes"))  # one row per centroid
    asked = rows.where("asks").groupBy("vkey").agg(F.first("v").alias("v"))
    asked = stored(asked.withColumn("lists", placer(probes, False)(F.col("v"))), "ann-asked")

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, found = [], []
        if len(left) and len(right):
            turn_ = sent.value[0]
            x = np.array(left["v"].tolist(), float)
            norms = (x**2).sum(axis=1)
            turned = (np.c_[x, np.sqrt(np.maximum(0, norms.max() - norms))] @ turn_).astype("f4")  # lengthened to the group's own longest
            q = np.array(right["v"].tolist(), float)
            turned_q = (np.c_[q, np.zeros(len(q))] @ turn_).astype("f4")
            least = right["bound"].to_numpy(float, na_value=-np.inf)  # a score of which k better ones are known
            known = norms.max() + (q**2).sum(axis=1) - 2 * least
            ids = left["ids"].tolist()
            for at in range(0, len(q), TOGETHER):
                left_over = adaptive_scan(turned, turned_q[at : at + TOGETHER], k + own, known[at : at + TOGETHER])
                for key, one, low, some in zip(right["vkey"][at : at + TOGETHER], q[at : at + TOGETHER], least[at : at + TOGETHER], left_over, strict=True):
                    scores = (x[some] * one).sum(axis=1)
                    some, scores = some[scores >= low], scores[scores >= low]
                    if len(some):
                        best = enough(sorted((-s, int(x["i"]), int(x["n"])) for s, row in zip(scores.tolist(), some, strict=True) for x in ids[row]), k)
                        keys.append(key)
                        found.append([{"s": s, "i": i} for s, i in best])
        return pd.DataFrame({"vkey": keys, "best": found}, dtype=object)

    def visited(visits: DataFrame, name: str) -> DataFrame:
        """Answers of visits (vkey, v, bound, list) to the lists, by shards of the list's rows and blocks of its queries."""
        blocks = visits.groupBy("list").count().select(F.col("list").alias("by"), F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("blocks"))
        cut = F.broadcast(stored(sizes.join(blocks, F.col("of") == F.col("by")).drop("by"), "ann-cut"))  # one row per centroid
        cand = placed.join(cut, F.col("list") == F.col("of")).withColumn("shard", F.pmod(F.xxhash64("vkey"), F.col("shards")).cast("int"))
        cand = cand.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "shard", "block", "ids", "v")
        asks = visits.join(cut, F.col("list") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("vkey"), F.col("blocks")).cast("int"))
        asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("list", "shard", "block", "vkey", "v", "bound")
        by = ("list", "shard", "block")
        return stored(cand.groupBy(*by).cogroup(asks.groupBy(*by)).applyInPandas(visit, "vkey string, best array<struct<s:double,i:bigint>>"), name)

    @F.pandas_udf("double")
    def kth(best: pd.Series) -> pd.Series:
        """The score of which k are known without any one id; null if there are none."""
        out = []
        for entries in best:
            some = enough(sorted((e["s"], e["i"], 1) for e in entries), k) if entries is not None else []
            times: dict[int, int] = {}
            for _, i in some:
                times[i] = times.get(i, 0) + 1
            out.append(-some[-1][0] if some and len(some) - max(times.values()) >= k else None)
        return pd.Series(out, dtype=float)

    def bounds(found: DataFrame) -> DataFrame:
        return found.groupBy("vkey").agg(F.flatten(F.collect_list("best")).alias("best")).select(F.col("vkey").alias("of_key"), kth("best").alias("bound"))

    first = asked.select("vkey", "v", F.lit(None).cast("double").alias("bound"), F.explode(F.slice("lists", 1, FIRST_PROBES)).alias("list"))
    met = visited(first, "ann-first")
    if probes > FIRST_PROBES:
        more = asked.join(bounds(met), F.col("vkey") == F.col("of_key"), "left").select("vkey", "v", "bound", F.explode(F.slice("lists", FIRST_PROBES + 1, probes)).alias("list"))
        met = met.unionByName(visited(more, "ann-more"))
    if probes < len(centre):
        lacking = asked.join(bounds(met).where("bound IS NOT NULL"), F.col("vkey") == F.col("of_key"), "left_anti")
        lacking = stored(lacking.select("vkey", "v", F.lit(None).cast("double").alias("bound"), F.explode(F.array_except(F.sequence(F.lit(0), F.lit(len(centre) - 1)), "lists")).alias("list")), "ann-lacking")
        if not lacking.isEmpty():
            met = met.unionByName(visited(lacking, "ann-rest"))
    top = met.groupBy("vkey").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    ours = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("vkey").alias("of_key")).join(top, F.col("of_key") == F.col("vkey"))
    mine = F.slice(F.filter("best", lambda b: b["i"] != F.col("query_id")), 1, k)
    return ours.select("query_id", F.posexplode(mine).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))
