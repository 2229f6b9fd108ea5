"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a
permutation given by an offset and a step hashed from its name.  The shards
take turns; at its turn a shard claims the first slot of its order that is
still free.  A document's slot is the hash of its key modulo the table's size,
so placement is one look-up in a table whose size is fixed (``SIZE`` rows,
broadcast), shards differ by at most one slot per unit of weight, and when the
set of shards changes few documents move.

Defined cases: a null key has a hash like any other; rows that repeat go to one
shard; an empty table gives no row; columns named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 65537


def _hash(name: str, seed: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = SIZE, weights: list[int] | None = None) -> list[int]:
    """For each slot the number of its shard; ``size`` is a prime above 100 times the shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime")
    if size < len(shards):
        raise ValueError("there are more shards than slots")
    turns = [i for i, w in enumerate(weights or [1] * len(shards)) for _ in range(w)]
    at = [_hash(s, "offset") % size for s in shards]
    step = [_hash(s, "step") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``docs`` with slot and shard (a name)."""
    rows = [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, size))]
    table = docs.sparkSession.createDataFrame(rows, "slot int, shard string")
    slot = F.pmod(F.xxhash64(key), F.lit(size)).cast("int")
    placed = docs.select(F.struct("*").alias("doc"), slot.alias("slot")).join(F.broadcast(table), "slot")
    return placed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")
