"""Length buckets with the least padding, and token-budget batches inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

import numpy as np

from geoloom.llm.store import WORD, staged


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds that minimise the total padding of the histogram ``{length: count}``.

    Dynamic programming over the distinct lengths: ``cost[j]`` for one bucket more is the
    least over the last cut of the cost so far plus the padding of the new bucket. Of equal
    costs the earliest cut wins. An empty histogram has no bounds.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    size = np.array(lengths, float)
    n = np.r_[0.0, np.cumsum([histogram[x] for x in lengths])]
    mass = np.r_[0.0, np.cumsum([histogram[x] * x for x in lengths])]
    m = len(lengths)
    cost = np.r_[0.0, np.full(m, np.inf)]
    cuts = []
    for _ in range(min(buckets, m)):
        now, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            whole = cost[:j] + size[j - 1] * (n[j] - n[:j]) - (mass[j] - mass[:j])
            cut[j] = int(np.argmin(whole))
            now[j] = whole[cut[j]]
        cuts.append(cut)
        cost = now
    bounds, j = [], m
    for cut in reversed(cuts):
        if j:
            bounds.append(lengths[j - 1])
            j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, buckets: int = 16, budget: int = 65536, group_rows: int = 100_000) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bucket_len, padding, batch_index)`` per piece of every document.

    Tokens are the words of a text. Texts beyond ``max_len`` tokens are cut into pieces of
    that many, so that the histogram has at most ``max_len`` lengths; the driver holds no
    more than these. All pieces of the data are counted in it. A batch holds as many
    pieces of one bucket as fit into ``budget`` tokens with padding. Pieces of a bucket are
    numbered in the order of a hash: counted by group of about ``group_rows``, numbered inside
    their group, and moved on by the rows of the groups before. So no task sorts a whole
    bucket, and in each bucket only the last batch is not full.

    A text without words, or null, gives one row of zero tokens with null bucket and batch.
    Rows with equal ids, and without id, keep a piece each for every row; among equal ones
    numbers go in any order. Other columns are ignored.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.cast("long").alias("words"))
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / max_len) - 1, F.lit(0)).cast("long"))
    pieces = counted.select("doc_id", "words", F.explode(cut).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * max_len).alias("start"), F.least(F.col("words") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"))
    pieces = staged(pieces, "pieces")
    histogram = {r["n_tokens"]: r["count"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    bounds = best_bounds(histogram, buckets)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    # groups of a bucket: as many as its rows ask for
    filled = {b: sum(c for n, c in histogram.items() if low < n <= b) for low, b in zip([0, *bounds], bounds)}
    groups = F.lit(1)
    for b, rows in filled.items():
        groups = F.when(F.col("bucket_len") == b, F.lit(-(-rows // group_rows))).otherwise(groups)
    order = F.xxhash64("doc_id", "piece")
    placed = pieces.where("n_tokens > 0").withColumn("bucket_len", bucket).withColumn("order", order).withColumn("grp", F.pmod("order", groups))
    before = W.partitionBy("bucket_len").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("bucket_len", "grp").count().select("bucket_len", "grp", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    inside = F.row_number().over(W.partitionBy("bucket_len", "grp").orderBy("order", "doc_id", "piece", "n_tokens"))
    numbered = placed.withColumn("nr", inside).join(sizes, ["bucket_len", "grp"])
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    full = numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.floor((F.col("skip") + F.col("nr") - 1) / per_batch).cast("long").alias("batch_index"),
    )
    none = F.lit(None).cast("long")
    return full.unionByName(pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", none.alias("bucket_len"), none.alias("padding"), none.alias("batch_index")))
