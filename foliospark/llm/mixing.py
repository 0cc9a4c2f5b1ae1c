"""Problem 9: a mixture of sources in which each holds a target share of the tokens.

Documents are sized in tokens of a public tokenizer (its file is a parameter). The total is
divided into equal blocks of tokens, and Sainte-Lague's highest quotients hand the blocks to
the sources, none more than its tokens times its permitted repeats; within a source the
same rule hands its blocks to shards. A shard is a hash part of a source, so a source of
any size spreads over many. In a shard documents stand in seeded order and the first blocks
are taken; where the quota is larger than the shard, the order begins again, so every
document is used ``n`` or ``n + 1`` times and never more than permitted.

Without ``total_tokens`` the total is the largest at which every source that has documents
holds its share. Sources are compared without case and blanks. Null, empty and unknown
sources and texts without tokens are not chosen; sources without documents are reported
with share 0. The driver sees one row per source and per shard (at most ``MAX_SHARDS``).
"""

from __future__ import annotations

import base64
import heapq
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.session import cut

from .base import map_batches, require

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level tokenizer parts words (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BLOCKS = 4000
SHARD_TOKENS = 20_000_000
MAX_SHARDS = 20_000
SEED = 17


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, sources: list[str] | None = None) -> DataFrame:
    """``doc_id, source, tokens``, with the source in its plain spelling; only ``sources``, if
    given, are tokenized."""

    docs.sparkSession.sparkContext.addFile(tokenizer)  # the driver's file goes to every executor
    name = os.path.basename(tokenizer)

    def make():
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        return lambda ids, sources, texts: [(i, s, len(encode(t))) for i, s, t in zip(ids, sources, texts)]

    plain = F.trim(F.lower(F.regexp_replace("source", r"\s+", " ")))
    rows = require(docs, "doc_id", "source", "text").where("doc_id is not null and text is not null and text <> ''")
    rows = rows.select("doc_id", plain.alias("source"), "text").where("source is not null and source <> ''")
    return map_batches(rows if sources is None else rows.where(F.col("source").isin(sources)), make, "doc_id bigint, source string, tokens bigint")


def sainte_lague(weights: dict, blocks: int, caps: dict) -> dict:
    """Integer quotas by highest quotients ``weight / (2 quota + 1)``; none above its cap.
    Ties go to the smaller key. Ends early where every cap is reached."""
    quota = dict.fromkeys(weights, 0)
    heap = [(-float(w), str(k), k) for k, w in weights.items() if w > 0 and caps[k] > 0]
    heapq.heapify(heap)
    for _ in range(blocks):
        if not heap:
            break
        _, name, k = heapq.heappop(heap)
        quota[k] += 1
        if quota[k] < caps[k]:
            heapq.heappush(heap, (-float(weights[k]) / (2 * quota[k] + 1), name, k))
    return quota


def select(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the chosen documents."""
    spark = docs.sparkSession
    goal = {r.source.strip().lower(): (float(r.target_share), int(r.max_repeats)) for r in require(targets, "source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    sized = cut(count_tokens(docs, tokenizer, list(goal)).where(F.col("tokens") > 0))
    has = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    empty = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, copies int")
    if not has:
        return empty
    share = sum(goal[s][0] for s in has)
    capacity = {s: t * goal[s][1] for s, t in has.items()}
    total = total_tokens or int(min(capacity[s] * share / goal[s][0] for s in has))
    size = max(1, total // blocks)
    quota = sainte_lague({s: goal[s][0] for s in has}, max(1, total // size), {s: capacity[s] // size for s in has})

    per_shard = max(SHARD_TOKENS, sum(has.values()) // MAX_SHARDS)
    shards = F.lit(1)
    for s, t in has.items():
        shards = F.when(F.col("source") == s, F.lit(-(-t // per_shard))).otherwise(shards)
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), shards))
    parts: dict[str, dict[int, int]] = {}
    for r in placed.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).collect():
        parts.setdefault(r.source, {})[r.shard] = r.t
    rows = []
    for s, own in parts.items():
        q = sainte_lague(own, quota[s], {k: -(-t * goal[s][1] // size) for k, t in own.items()})
        rows += [(s, k, t, q[k] * size, goal[s][1]) for k, t in own.items()]
    plan = spark.createDataFrame(rows, "source string, shard bigint, shard_tokens bigint, wanted bigint, max_repeats int")
    before = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy(order, "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    laid = placed.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(plan), ["source", "shard"])
    # a document is taken once for each round in which its middle lies before the quota's end
    middle = F.col("before") + F.col("tokens") / 2
    copies = F.least(F.greatest(F.ceil((F.col("wanted") - middle) / F.col("shard_tokens")), F.lit(0)), F.col("max_repeats")).cast("int")
    return laid.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens, documents, most copies, the share reached, and whether the
    source is ``exhausted``, every chosen document used as often as permitted: without
    ``total_tokens`` that is the source that sets the size of the whole."""
    plain = require(targets, "source", "target_share", "max_repeats").select(F.trim(F.lower("source")).alias("source"), "target_share", "max_repeats")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.min("copies").alias("_least"))
    both = plain.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per source
    share = F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0))
    return both.withColumn("actual_share", share).withColumn("exhausted", F.coalesce(F.col("_least") >= F.col("max_repeats"), F.lit(False))).drop("_least")
