"""Filling containers of fixed capacity with tokenised documents."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Where the vocabulary file of the tokenizer lies; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that goes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Limits of one container: tokens, segments, and tokens that bear loss (fewer than tokens, so that each limit can be the one that is met).
CAPACITY, SEGMENTS, LOSS = 2048, 64, 1792
#: What ends the prompt of a document, which bears no loss.
PROMPT_END = "\n\n"
#: Pieces packed together by one task.
SHARD = 10_000
#: Characters tokenised at once, at least; longer texts are cut at the next place where the splitting pattern cuts whatever stands around.
STRETCH = 100_000
# a blank between a mark or letter and a letter or digit: what follows begins a part of its own, blank included
_SEAM = re.compile(r"(?<=\S) (?=[^\W_])")


def tokenizer(path: str = VOCABULARY):
    """The public tokenizer whose vocabulary lies at `path`."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """A long text in parts that tokenise as they would together; a text without a seam stays whole."""
    out, start = [], 0
    while len(text) - start > size:
        seam = _SEAM.search(text, start + size)
        if seam is None:
            break
        out.append(text[start : seam.start()])
        start = seam.start()
    return [*out, text[start:]]


def tokens_in(encode, text: str) -> int:
    """Number of tokens of a whole text."""
    return sum(len(encode(s)) for s in stretches(text))


def pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, prompt_end: str = PROMPT_END
) -> DataFrame:
    """Documents as pieces no longer than a container: doc_id, piece, first_token, n_tokens, loss_tokens.

    A document is the prompt up to the first `prompt_end`, if it has one, which bears no loss, and the rest, which does. Only
    a document that exceeds a container is cut, into full pieces and a rest. Null and empty texts give one piece of no tokens.
    """
    kind = dict(docs.dtypes)[doc_id]

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode_ordinary
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"]):
                t = t or ""
                n = tokens_in(encode, t)
                at = t.find(prompt_end)
                free = min(n, tokens_in(encode, t[:at].rstrip())) if at > 0 else 0
                for k, a in enumerate(range(0, n, capacity) if n else [0]):
                    z = min(n, a + capacity)
                    rows.append((i, k, a, z - a, z - max(a, min(z, free))))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "n_tokens", "loss_tokens"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInPandas(
        cut_up, f"doc_id {kind}, piece int, first_token int, n_tokens int, loss_tokens int"
    )


def pack(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item (rows of `demand`), no container above `limits` in any column.

    Containers are filled one after another: the next item is the one, among those that still fit, whose demand has
    the greatest dot product with the room left, both as shares of the limits. Equal items are handled as one class, so a
    step costs a product over the distinct demands.
    """
    kinds, member = np.unique(demand, axis=0, return_inverse=True)
    member = member.reshape(-1)
    order = np.argsort(member, kind="stable")
    bounds = np.searchsorted(member[order], np.arange(len(kinds) + 1))
    left = np.diff(bounds).copy()
    share = kinds / limits
    if (share > 1).any():
        raise ValueError("an item exceeds a container")
    out = np.empty(len(demand), np.int64)
    container, placed = -1, 0
    live = np.arange(len(kinds))
    while placed < len(demand):
        container += 1
        room = np.ones(len(limits))
        live = live[left[live] > 0]
        fit = live
        while len(fit):
            fit = fit[(share[fit] <= room + 1e-12).all(axis=1)]
            fit = fit[left[fit] > 0]
            if not len(fit):
                break
            k = fit[np.argmax(share[fit] @ room)]
            out[order[bounds[k] + left[k] - 1]] = container
            left[k] -= 1
            placed += 1
            room = room - share[k]
    return out


def fill_containers(
    items: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int = LOSS, shard: int = SHARD
) -> DataFrame:
    """Add `container` to pieces (see `pieces`), with limits on tokens, segments and loss-bearing tokens at once.

    A piece that alone bears more loss than the limit is not cut for it: it takes the whole limit, so only pieces without loss join it.
    Pieces are dealt at random into shards of about `shard` pieces, each packed by one task, so a shard's size does not
    depend on the size of the table or on any key; what a shard leaves unused is about one container. A piece as
    long as a container needs no company. Pieces of no tokens take a segment like others. An empty table stays empty.
    """
    items = cut(items)
    shards = max(1, -(-items.count() // shard))
    dealt = items.withColumn("__s", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    # the shard's number is the number of its partition, so no task packs two
    dealt = dealt.repartitionById(shards, "__s")

    def pack_shard(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece"]).reset_index(drop=True)
        demand = np.column_stack([group["n_tokens"], np.ones(len(group), np.int64), np.minimum(group["loss_tokens"], loss_capacity)])
        group["container"] = pack(demand, np.array([capacity, segments, loss_capacity])) * shards + group["__s"]
        return group.drop(columns="__s")

    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", container long"
    return dealt.groupBy("__s").applyInPandas(pack_shard, schema)


def containers(packed: DataFrame) -> DataFrame:
    """One row per container: its tokens, segments, loss-bearing tokens and the loss of its greatest piece."""
    return packed.groupBy("container").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"), F.max("loss_tokens").alias("most_loss")
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int = LOSS) -> DataFrame:
    """One row: containers, the fewest that any packing could need, how far each limit is used (percent), and how many containers meet each limit."""
    c = containers(packed).withColumn("bound", F.least("loss", F.lit(loss_capacity)))
    share = lambda x, most: F.round(F.try_divide(100.0 * F.sum(x), F.count("*") * most), 3)
    fewest = F.greatest(*[F.ceil(F.sum(x) / most) for x, most in (("tokens", capacity), ("segments", segments), ("bound", loss_capacity))])
    return c.agg(
        F.count("*").alias("containers"), F.coalesce(fewest, F.lit(0)).alias("fewest"), share("tokens", capacity).alias("tokens_used"), share("segments", segments).alias("segments_used"),
        share("bound", loss_capacity).alias("loss_used"), *[F.count_if(F.col(x) >= most).alias(f"{x}_met") for x, most in (("tokens", capacity), ("segments", segments), ("loss", loss_capacity))],
    )
