"""Mixing sources to target shares of tokens by entropy balancing (problem 8).

The rates w of a mix's documents are the ones closest (in Kullback-Leibler divergence) to
one copy of everything that meet every source's token target with no rate above the
source's cap.  Their form is known: w = min(cap, exp(lambda_source * tokens / scale)), so
only the multipliers of the convex dual have to be found.  Each Newton iteration is one
aggregation; documents enter it collapsed by (source, tokens), of which there are few
however large the corpus.  Rates become whole copies by systematic rounding inside many
small hash buckets of a source, so no source is ever ordered in one task.

Tokens are counted with the public byte-level BPE vocabulary for many languages
(``byte_bpe_multi_50k.tiktoken``, 50,256 tokens); its path is a parameter.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-splitting pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUNDS, CLOSE, BUCKET = 200, 1e-6, 500
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once per process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _ENCODINGS[path] = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens``, sources in one spelling. Documents without tokens, source or key are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(enc.encode_ordinary(x)) for x in pdf["text"]]})

    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")
    rows = documents.where(F.col(key).isNotNull() & F.col(source).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("doc_id"), name.alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "doc_id bigint, source string, n_tokens int").where("n_tokens > 0")


def _goals(sizes: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    """``mix_id, source, target_share, max_repeats, goal, scale, have``: tokens wanted of every source of a mix.

    Without ``total`` a mix is as large as its scarcest source allows.  Sources without
    documents cannot be mixed: their goal is 0 and the others keep their proportions.
    """
    have = sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("have"), F.max("n_tokens").alias("scale"))
    name = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_")
    wanted = targets.where("mix_id IS NOT NULL AND source IS NOT NULL AND target_share > 0").select("mix_id", name.alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(have, "source", "left").withColumn("can", F.coalesce(F.col("have") * F.col("max_repeats"), F.lit(0)))
    mix = Window.partitionBy("mix_id")
    live = F.when(F.col("can") > 0, F.col("target_share"))
    share = live / F.sum(live).over(mix)
    limit = F.min(F.col("can") / share).over(mix)
    size = limit if total is None else F.lit(float(total))
    return both.withColumn("goal", F.least(F.coalesce(share * size, F.lit(0.0)), F.col("can").cast("double"))).select("mix_id", "source", "target_share", "max_repeats", "goal", "scale", "have")


def multipliers(sizes: DataFrame, goals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``mix_id, source, lambda, max_repeats``: the dual solution. ``sizes``: source, n_tokens, n.

    Newton's method per constraint with bisection as its safeguard; the constraints of a mix
    do not share documents, so its Hessian is diagonal.  A source whose goal needs every cap
    gets an infinite multiplier.  A dual that has not converged after ``rounds`` is an error, not a result.
    """
    state = cut(
        goals.where("goal > 0").select(
            "mix_id", "source", "max_repeats", "goal", "scale", "have", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (F.col("goal") >= F.col("have") * F.col("max_repeats") * (1 - 1e-9)).alias("full")
        )
    )
    for _ in range(rounds):
        rate = F.least(F.col("max_repeats").cast("double"), F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("scale"), F.lit(700.0))))
        free = rate < F.col("max_repeats")
        step = state.join(sizes, "source").groupBy("mix_id", "source").agg(
            F.sum(F.col("n") * rate * F.col("n_tokens")).alias("got"),
            F.sum(F.when(free, F.col("n") * rate * F.col("n_tokens") * F.col("n_tokens") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        new = state.join(step, ["mix_id", "source"])
        low = F.when(F.col("got") < F.col("goal"), F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(F.col("got") >= F.col("goal"), F.least("high", "lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("got") - F.col("goal")) / F.col("slope")
        middle = F.when(high >= 1e6, F.greatest(low * 2, low + 1)).when(low <= -1e6, F.least(high * 2, high - 1)).otherwise((low + high) / 2)
        moved = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        done = F.col("full") | (F.abs(F.col("got") - F.col("goal")) <= F.col("goal") * CLOSE)
        new = cut(new.select("mix_id", "source", "max_repeats", "goal", "scale", "have", F.when(done, F.col("lam")).otherwise(moved).alias("lam"), low.alias("low"), high.alias("high"), "full", done.alias("done")))
        state = new.drop("done")
        if new.where("NOT done").isEmpty():
            break
    else:
        raise ArithmeticError(f"the dual has not converged in {rounds} rounds")
    return state.select("mix_id", "source", "max_repeats", "scale", F.when(F.col("full"), F.lit(math.inf)).otherwise(F.col("lam")).alias("lam"))


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``mix_id, doc_id, source, n_tokens, copies``: the chosen documents of every mix, copies at least 1.

    Null or blank texts, unknown sources and mixes without any reachable source give no rows;
    a repeated doc_id counts once.  ``total`` asks for so many tokens, as far as the caps allow.
    """
    counted = cut(token_counts(documents, tokenizer=tokenizer).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")))
    sizes = cut(counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    goals = _goals(sizes, targets, total)
    duals = multipliers(sizes, goals)
    buckets = sizes.groupBy("source").agg(F.ceil(F.sum("n") / F.lit(BUCKET)).alias("buckets"))
    plan = duals.join(buckets, "source")
    rated = counted.join(plan, "source").withColumn("rate", F.least(F.col("max_repeats").cast("double"), F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("scale"), F.lit(700.0)))))
    rated = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets"))).withColumn("turn", F.xxhash64("doc_id", "mix_id"))
    # Systematic rounding: a document gets one copy for every whole number its running sum of rates passes.
    along = Window.partitionBy("mix_id", "source", "bucket").orderBy("n_tokens", "turn", "doc_id")
    start = F.pmod(F.xxhash64("mix_id", "source", "bucket"), F.lit(1000)) / 1000.0
    upto = F.sum("rate").over(along.rowsBetween(Window.unboundedPreceding, 0)) + start
    copies = F.least(F.floor(upto + 1e-9) - F.floor(upto - F.col("rate") + 1e-9), F.col("max_repeats"))
    return rated.withColumn("copies", copies.cast("int")).where("copies > 0").select("mix_id", "doc_id", "source", "n_tokens", "copies")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_id, source, target_share, actual_share, tokens, documents, copies`` for every wanted source."""
    name = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_")
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    wanted = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", name.alias("source")).agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "documents", "copies"])
    everything = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return both.withColumn("actual_share", F.when(everything > 0, F.col("tokens") / everything).otherwise(0.0)).select("mix_id", "source", "target_share", "actual_share", "tokens", "documents", "copies")
