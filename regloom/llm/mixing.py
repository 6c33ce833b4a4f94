"""Mixing sources to target weights by min-cost flow.

Records with equal text are one record that belongs to every listed source in which a copy appears. Records are
aggregated by that membership pattern to token totals (few rows: at most one per set of sources seen). A flow
routes the tokens of each pattern to the quotas of its sources; the r-th use of a pattern's tokens costs more than the
one before it (convex), so fresh text goes first and small sources are repeated only as far as they must, at
most ``max_repeats`` times. Without a given size the mix is the largest for which every source that has records
meets its quota. Records are then selected in a seeded order; the running totals come from sums by hash bucket, so no task
sees a whole source.

Defined results: records with null, unlisted or no source, and null or empty texts take no part; source names are
compared without case and outer space; a listed source without records gets no tokens and the report shows the
shortfall; a record in several sources may be used as often as the strictest of them allows; a quota is missed by less than
one record per pattern.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regloom.session import materialise, prepare

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Hash buckets per pattern for distributed running totals.
BUCKETS = 4096


class MinCostFlow:
    """Successive shortest paths with potentials; integer capacities and non-negative costs."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.edges: list[list[int]] = []  # to, capacity, cost
        self.at: list[list[int]] = [[] for _ in range(n)]

    def add(self, u: int, v: int, capacity: int, cost: int) -> int:
        self.at[u].append(len(self.edges))
        self.edges.append([v, capacity, cost])
        self.at[v].append(len(self.edges))
        self.edges.append([u, 0, -cost])
        return len(self.edges) - 2

    def run(self, s: int, t: int) -> int:
        potential = [0] * self.n
        total = 0
        while True:
            far = [float("inf")] * self.n
            far[s] = 0
            via = [-1] * self.n
            queue = [(0, s)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for e in self.at[u]:
                    v, capacity, cost = self.edges[e]
                    if capacity > 0 and (x := d + cost + potential[u] - potential[v]) < far[v]:
                        far[v], via[v] = x, e
                        heapq.heappush(queue, (x, v))
            if via[t] < 0:
                return total
            for v in range(self.n):
                if far[v] < float("inf"):
                    potential[v] += int(far[v])
            push, v = float("inf"), t
            while v != s:
                push = min(push, self.edges[via[v]][1])
                v = self.edges[via[v] ^ 1][0]
            v = t
            while v != s:
                self.edges[via[v]][1] -= push
                self.edges[via[v] ^ 1][1] += push
                v = self.edges[via[v] ^ 1][0]
            total += int(push)


@dataclass(frozen=True)
class Plan:
    """Tokens each pattern sends to each source, and the size aimed at."""

    flows: dict[tuple[tuple[str, ...], str], int]
    size: int


def _solve(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    names, sources = list(patterns), list(quotas)
    flow = MinCostFlow(2 + len(names) + len(sources))
    links = {}
    for i, p in enumerate(names):
        for r in range(min(repeats[s] for s in p)):
            flow.add(0, 2 + i, patterns[p], r * r)
        for s in p:
            links[p, s] = flow.add(2 + i, 2 + len(names) + sources.index(s), 1 << 62, 0)
    for j, s in enumerate(sources):
        flow.add(2 + len(names) + j, 1, quotas[s], 0)
    total = flow.run(0, 1)
    return total, {k: flow.edges[e ^ 1][1] for k, e in links.items()}


def plan_mix(patterns: dict[tuple[str, ...], int], weights: dict[str, tuple[float, int]], size: int | None = None) -> Plan:
    """Flow of tokens; ``patterns``: tokens by sorted sources, ``weights``: (share, repeats) by source."""
    patterns = {p: t for p, t in patterns.items() if t > 0}
    repeats = {s: w[1] for s, w in weights.items()}
    filled = {s: weights[s][0] for s in weights if any(s in p for p in patterns) and weights[s][0] > 0 and repeats[s] > 0}
    if not filled:
        return Plan({}, 0)
    present = sum(filled.values())

    def quotas(n: int) -> dict[str, int]:
        return {s: int(n * share / present) for s, share in filled.items()}

    agg: dict[tuple[str, ...], int] = {}
    for p, t in patterns.items():
        q = tuple(s for s in p if s in filled)
        if q:
            agg[q] = agg.get(q, 0) + t
    if size is None:
        low, high = 0, sum(t * max(repeats[s] for s in p) for p, t in agg.items()) + 1
        while high - low > 1:
            mid = (low + high) // 2
            q = quotas(mid)
            if _solve(agg, q, repeats)[0] >= sum(q.values()):
                low = mid
            else:
                high = mid
        size = low
    return Plan(_solve(agg, quotas(size), repeats)[1], size)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, text_hash, tokens); the file ``tokenizer`` of the driver is sent along, so executors need not have it."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(name))
        t.encode_special_tokens = True
        for b in batches:
            texts = b.column(2).to_pylist()
            n = [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
            digest = [xxhash.xxh3_128_digest(x) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "source", "text_hash", "tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    return rows.filter("text <> '' and source is not null").mapInArrow(count, "doc_id long, source string, text_hash binary, tokens long")


def mix(documents: DataFrame, weights: DataFrame, size: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    mix: doc_id, source, uses, tokens (of one use) - a record may appear once for each source it counts for;
    report: source, target_share, tokens, actual_share, records, most_uses, copied_tokens (tokens of further copies of a text within the source, which
    count once). ``weights`` is the list of sources, a few rows.
    """
    spark = documents.sparkSession
    prepare(spark)
    listed = {r["source"].strip().lower(): (float(r["target_share"]), int(r["max_repeats"])) for r in weights.filter("source is not null").select("source", "target_share", "max_repeats").collect()}
    names = [s for s, w in listed.items() if w[0] > 0 and w[1] > 0]
    counted = token_counts(documents, tokenizer).filter(F.col("source").isin(names) & (F.col("tokens") > 0))
    # one record per text; the set of its sources has at most as many members as there are listed sources
    held = materialise(counted.groupBy("text_hash", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.count("*").alias("copies")), "texts")
    copied = held.groupBy("source").agg(F.sum((F.col("copies") - 1) * F.col("tokens")).alias("copied_tokens"))
    records = materialise(
        held.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern")), "records"
    )
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")
    records = records.withColumn("bucket", bucket).withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id"))
    sums = materialise(records.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("bucket_tokens")), "buckets")
    totals = {tuple(r["pattern"]): r["t"] for r in sums.groupBy("pattern").agg(F.sum("bucket_tokens").alias("t")).collect()}
    plan = plan_mix(totals, listed, size)
    spans, begun = [], {}
    for (p, s), flow in plan.flows.items():
        if flow > 0:
            spans.append((list(p), s, begun.get(p, 0), begun.get(p, 0) + flow, totals[p]))
            begun[p] = begun.get(p, 0) + flow
    spans_df = spark.createDataFrame(spans, "pattern array<string>, use_source string, span_from long, span_to long, pattern_tokens long")
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0))).drop("bucket_tokens")
    inside = Window.partitionBy("pattern", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = records.withColumn("in_bucket", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(F.broadcast(offsets) if BUCKETS * len(totals) < 1_000_000 else offsets, ["pattern", "bucket"])
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("in_bucket"))
    # use r of a record starts at r * pattern_tokens + start; it counts for the source whose span holds that point
    first = F.ceil((F.col("span_from") - F.col("start")) / F.col("pattern_tokens"))
    last = F.ceil((F.col("span_to") - F.col("start")) / F.col("pattern_tokens"))
    uses = (last - F.greatest(first, F.lit(0))).cast("int")
    mixed = placed.join(F.broadcast(spans_df), "pattern").withColumn("uses", uses).filter("uses > 0").select("doc_id", F.col("use_source").alias("source"), "uses", "tokens")
    got = mixed.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("tokens").alias("total"))
    target = spark.createDataFrame([(s, w[0], w[1]) for s, w in listed.items()], "source string, target_share double, max_repeats int")
    report = (
        target.join(got, "source", "left")
        .join(copied, "source", "left")
        .withColumn("one", F.lit(1))
        .join(total.withColumn("one", F.lit(1)), "one")
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.coalesce("copied_tokens", F.lit(0)).alias("copied_tokens"),
        )
    )
    return mixed, report
