"""Documents into containers of fixed capacity: best-two-fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary parts a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken file, one per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """item (a number for each row), doc_id and n_tokens of the whole text; null ids and texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "item"])

    data = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("item")).where("doc_id is not null and text is not null")
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, item bigint")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, sizes from 1 to capacity.

    Each container takes the largest item that fits until none does. Then its smallest item
    leaves if two unpacked items fill the larger gap more tightly than it did: the best such pair by sum,
    of equal sums the one with the larger first item. Works on the number of items per size.
    """
    sizes = np.asarray(sizes, np.int64)
    order = np.argsort(sizes, kind="stable")
    count = np.bincount(sizes, minlength=capacity + 1)
    first = np.cumsum(count) - count  # where the items of a size start in order
    idx = np.arange(capacity + 1)
    out = np.empty(len(sizes), np.int64)
    left = len(sizes)
    bins = 0

    def largest() -> np.ndarray:
        """For each gap the largest size at hand that fits it, or 0."""
        return np.maximum.accumulate(np.where(count > 0, idx, 0))

    fit = largest()
    while left:
        gap, held = capacity, []
        while s := int(fit[gap]):
            held.append(s)
            gap -= s
            left -= 1
            count[s] -= 1
            if not count[s]:
                fit = largest()
        if gap and left and len(held) > 1:
            small = held[-1]
            room = gap + small
            a = np.nonzero(count[: room + 1])[0]
            if len(a):
                b = fit[room - a]
                twice = (b == a) & (count[a] < 2)
                if twice.any():  # the next smaller size then
                    below = np.concatenate([[0], fit[:-1]])
                    b = np.where(twice, below[a], b)
                total = np.where(b > 0, a + b, 0)
                k = len(a) - 1 - int(total[::-1].argmax())
                if total[k] > small:
                    held[-1:] = [int(a[k]), int(b[k])]
                    count[a[k]] -= 1
                    count[b[k]] -= 1
                    count[small] += 1
                    left -= 1
                    fit = largest()
        for s in held:
            # the last items of each size go first; which of equal items goes where does not matter
            out[order[first[s]]] = bins
            first[s] += 1
        bins += 1
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_items: int = 50_000, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document's place: container, doc_id, part, n_tokens.

    A document of more than capacity tokens, and only such a one, is cut: parts 0, 1, ... of capacity tokens
    and the rest. Null or empty texts have no place. Repeated rows are items of their own. The
    packing is that of best_two_fit in each shard.

    Plan: the tokens are counted in one pass without a shuffle; then one number per document is shuffled
    into shards of about shard_items items by the hash of the row, so that a task is bounded however
    many equal documents there are. Containers are not shared between shards, which costs half a
    container each. The counts are kept in the shared folder, for the number of shards depends on them.
    """
    sized = cut(token_counts(docs, doc_id, text, tokenizer).where("n_tokens > 0"))
    total = sized.count()
    shards = max(1, -(-total // shard_items))
    kind = sized.schema["doc_id"].dataType.simpleString()
    whole = F.call_function("div", F.col("n_tokens"), F.lit(capacity).cast("bigint"))
    parts = F.sequence(F.lit(0).cast("bigint"), whole - F.when(F.col("n_tokens") % capacity == 0, 1).otherwise(0))
    pieces = sized.withColumn("part", F.explode(parts)).select("item", "doc_id", F.col("part").cast("int").alias("part"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("part") * capacity).alias("n_tokens"), F.pmod(F.xxhash64("item", "doc_id", "part"), F.lit(shards)).alias("shard"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item", "part"], ignore_index=True)
        return pd.DataFrame({"container": best_two_fit(pdf["n_tokens"].to_numpy(), capacity) + (int(key[0]) << 40), "doc_id": pdf["doc_id"], "part": pdf["part"], "n_tokens": pdf["n_tokens"]})

    return pieces.groupBy("shard").applyInPandas(pack, f"container bigint, doc_id {kind}, part int, n_tokens bigint")
