"""Merkle root of a history in walk order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import leaf, tree_root

#: Leaves a task folds at once; a power of two, so that chunks are whole subtrees.
CHUNK = 1 << 12


def merkle_root(leaves: DataFrame, keys: list[str], pos: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """keys, merkle_root (hex), n of leaves(keys, pos, value); pos is 0-based without gaps in each group.

    RFC 6962: leaves are prefixed by 0x00, nodes by 0x01, and a tree splits at the
    largest power of two below its size, so aligned chunks are subtrees and roots
    of chunks fold like leaves.  Each round shrinks a group by `chunk`; a round is
    one shuffle of 32-byte hashes, so a group of 10**10 leaves takes three.
    """
    longest = leaves.agg(F.max(pos)).first()[0]
    spark = leaves.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.select(*keys).schema)
    schema = ", ".join(x for x in (kinds, "at long, hash binary, n long") if x)

    def folded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        out = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame(out | {"at": [int(group["at"].iloc[0]) // chunk], "hash": [tree_root([bytes(x) for x in group["hash"]])], "n": [int(group["n"].sum())]})

    def first(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            batch["hash"] = [leaf(x.encode()) for x in batch["hash"]]
            yield batch

    rows = leaves.select(*keys, F.col(pos).cast("long").alias("at"), F.col(value).cast("string").alias("hash"), F.lit(1).cast("long").alias("n")).mapInPandas(first, schema)
    left = (longest or 0) + 1
    while True:
        rows = rows.groupBy(*keys, F.floor(F.col("at") / chunk).alias("__chunk")).applyInPandas(folded, schema)
        left = -(-left // chunk)
        if left <= 1:
            break
    found = rows.select(*keys, F.lower(F.hex("hash")).alias("merkle_root"), "n")
    if keys or longest is not None:
        return found
    return spark.createDataFrame([(tree_root([]).hex(), 0)], "merkle_root string, n long")
