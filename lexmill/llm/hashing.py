"""Hashes of tokens and of whole sets, which several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import Scratch, small

_U = np.uint64
#: Distinct sets up to which their names are sent to all executors (12 MB); else their records are shuffled.
MOST_SETS = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fold_copies(rows: DataFrame, scratch: Scratch, whole: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct sets ``(id, tokens, ...)``, named by their smallest record, and ``members (doc_id, id)``. Equal sets
    meet by two hashes of the sorted tokens and their number, 128 bits in all. Where ``whole`` is false the tokens are
    not all of the set and the row stays by itself."""
    more = [c for c in rows.columns if c not in ("doc_id", "tokens")]
    n = F.size("tokens").cast("long")
    kept = scratch.keep(
        rows.select(
            "doc_id", "tokens", *more, F.xxhash64("tokens").alias("h"), F.xxhash64(F.lit(7), F.col("tokens")).alias("g"),
            (n if whole is None else F.when(whole, n).otherwise(-1 - F.col("doc_id"))).alias("n"),
        )
    )
    first = scratch.keep(kept.groupBy("h", "g", "n").agg(F.min("doc_id").alias("id")))
    first = small(first, MOST_SETS)
    members = scratch.keep(kept.select("doc_id", "h", "g", "n").join(first, ["h", "g", "n"]).select("doc_id", "id"))
    sets = kept.join(first.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "tokens", *more)
    return scratch.keep(sets), members
