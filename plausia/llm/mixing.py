"""Mixing sources to target weights.

A source's repeat factor is its target over its tokens, at most its cap. The whole part is copies that every
record has; the fraction is rounded by the pivotal method: two records with fractional probabilities pass
mass to one another, at random and keeping the expected tokens, until one of them is whole. Groups of records
are rounded first; the residual of each group goes up a reduction tree until one per source is left.
"""

from __future__ import annotations

import base64
import os
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, spread

#: The vocabulary's file (ranks of ``tiktoken``, or JSON of ``tokenizers``), a parameter everywhere below; and the
#: pattern that cuts texts before the ranks apply, a fixed value that belongs to them.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP_ROWS, FAN_IN = 50_000, 256
_LEFT = "source string, slot long, doc_id long, n_tokens long, p double, settled boolean"


def _lengths(tokenizer_file: str) -> Callable[[list[str]], list[int]]:
    if tokenizer_file.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    with open(tokenizer_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def _counter(tokenizer_file: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lengths = _lengths(tokenizer_file)
        for docs in batches:
            yield pd.DataFrame({"doc_id": docs["doc_id"], "source": docs["source"], "n_tokens": lengths(list(docs["text"]))})

    return count


def token_sizes(documents: DataFrame, tokenizer_file: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of whole texts; a null text has no tokens, rows without an id are left out."""
    docs = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce("text", F.lit("")).alias("text")))
    return docs.mapInPandas(_counter(tokenizer_file), "doc_id long, source string, n_tokens long")


def repeat_factors(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: tokens there are, tokens wanted and the repeat factor.

    Without ``total_tokens`` the mixture is as large as the caps allow while every source that has tokens
    keeps its weight.
    """
    goals = targets.where("source is not null and weight > 0").groupBy("source").agg(F.max("weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    there = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    plan = goals.join(there, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    if total_tokens is None:
        total_tokens = plan.where("tokens > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("weight"))).first()[0] or 0
    wanted = F.col("weight") * F.lit(float(total_tokens))
    return plan.withColumn("wanted", wanted).withColumn("factor", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), wanted / F.col("tokens"))).otherwise(0.0))


def pivot(p: list[float], size: list[int], rng: random.Random) -> tuple[list[float], int | None]:
    """Rounds all but at most one of the probabilities, keeping the sum of probability times size."""
    held = None
    p = list(p)
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if size[j] == 0:
            p[j] = float(rng.random() < p[j])
            continue
        if held is None:
            held = j
            continue
        ratio = size[held] / size[j]
        up, down = min(1 - p[held], p[j] / ratio), min(p[held], (1 - p[j]) / ratio)
        step = up if rng.random() * (up + down) < down else -down
        a, b = p[held] + step, p[j] - step * ratio
        p[held], p[j] = (round(x) if min(x, 1 - x) < 1e-12 else x for x in (a, b))
        held = held if 0 < p[held] < 1 else j if 0 < p[j] < 1 else None
    return p, held


def _round_group(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slot", "doc_id"], kind="stable")
        slot = int(group["slot"].iloc[0]) // FAN_IN
        rng = random.Random(f"{seed}/{group['source'].iloc[0]}/{slot}/{group['doc_id'].iloc[0]}")
        p, held = pivot(list(group["p"]), list(group["n_tokens"]), rng)
        if last and held is not None:
            p[held] = float(rng.random() < p[held])
        return pd.DataFrame({"source": group["source"], "slot": slot, "doc_id": group["doc_id"], "n_tokens": group["n_tokens"], "p": p, "settled": [x in (0, 1) for x in p]})

    return rounded


def mix(documents: DataFrame, targets: DataFrame, *, tokenizer_file: str = TOKENIZER, total_tokens: int | None = None, seed: int = 1, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: each document of a target source with its number of copies, which
    is the source's repeat factor rounded down or up and never above its cap.

    The same input and seed give the same copies. Sources without a target, null ones included, are left out.
    """
    sizes = materialize(token_sizes(documents, tokenizer_file), "sizes")
    plan = materialize(repeat_factors(sizes, targets, total_tokens).select("source", "factor", "n_docs"), "plan")
    rows = sizes.join(plan, "source").withColumn("whole", F.floor("factor").cast("long")).withColumn("p", F.col("factor") - F.floor("factor"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / group_rows))
    fractional = rows.where("p > 0").select("source", (F.pmod(F.xxhash64("doc_id"), groups) * FAN_IN).alias("slot"), "doc_id", "n_tokens", "p")
    most = plan.agg(F.max("n_docs")).first()[0] or 0
    width, settled = max(1, -(-most // group_rows)), []
    while True:
        done = materialize(fractional.groupBy("source", F.floor(F.col("slot") / FAN_IN).alias("node")).applyInPandas(_round_group(seed, width == 1), _LEFT), "rounded")
        settled.append(done.where("settled").select("doc_id", "p"))
        if width == 1:
            break
        fractional, width = done.where("not settled").drop("settled"), -(-width // FAN_IN)
    extra = settled[0]
    for s in settled[1:]:
        extra = extra.unionAll(s)
    return rows.join(extra.withColumnRenamed("p", "more"), "doc_id", "left").select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("more", F.lit(0.0))).cast("long").alias("copies"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, weight, max_repeats, n_docs, most_copies, tokens, mixed_tokens, share, total_tokens, binding``: what was reached,
    of how many tokens in all, and which sources are used up: every document of theirs stands there ``max_repeats``
    times, so that they bound the total."""
    sized = F.when(F.col("n_tokens") > 0, F.col("copies"))
    got = mixture.groupBy("source").agg(
        F.count_if(F.col("copies") > 0).alias("n_docs"), F.max("copies").alias("most_copies"), F.min(sized).alias("_fewest"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens")
    )
    total = got.agg(F.sum("mixed_tokens")).first()[0] or 0
    goals = targets.where("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    out = goals.join(got, "source", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    share = F.round(F.coalesce("mixed_tokens", F.lit(0)) / F.lit(max(1, total)), 6)
    binding = F.coalesce(F.col("_fewest") >= F.coalesce("max_repeats", F.lit(1)), F.lit(False))
    return out.select("source", "weight", "max_repeats", *map(number, ("n_docs", "most_copies", "tokens", "mixed_tokens")), share.alias("share"), F.lit(total).cast("long").alias("total_tokens"), binding.alias("binding"))
