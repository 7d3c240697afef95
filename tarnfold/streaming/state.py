"""Operators with state by key: reservoir samples and Bloom filters."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def reservoir_state(stream: DataFrame, key: str, value: str, size: int = 100, seed: int = 553, every: int | None = None) -> DataFrame:
    """``key, seen, held, slots`` after each batch, or with ``every`` after so many events of a key: fill, then keep a new event with probability size / seen, in any slot.

    The draw for an event depends on seed, key and its number, so a batch that runs again gives the same sample.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, slots = state.get if state.exists else (0, [])
        slots, out = list(slots), []
        for v in pd.concat(list(batches), ignore_index=True).sort_values("_order")["_value"]:
            seen += 1
            if len(slots) < size:
                slots.append(int(v))
            elif (draw := random.Random(f"{seed}:{k[0]}:{seen}")).random() < size / seen:
                slots[draw.randrange(size)] = int(v)
            if every and seen % every == 0:
                out.append((k[0], seen, len(slots), ",".join(map(str, slots[::20]))))
        if not every:
            out.append((k[0], seen, len(slots), ",".join(map(str, slots[::20]))))
        state.update((seen, slots))
        yield pd.DataFrame(out, columns=["key", "seen", "held", "slots"])

    rows = stream.selectExpr(f"{key} AS _key", f"{value} AS _value", "event_id AS _order")
    return rows.groupBy("_key").applyInPandasWithState(step, "key string, seen bigint, held bigint, slots string", "seen bigint, slots array<bigint>", "append", GroupStateTimeout.NoTimeout)


def bloom_state(stream: DataFrame, key: str, value: str, bits: int, hashes: list[tuple[int, int]]) -> DataFrame:
    """``key, event_id, value, taken_for_seen`` of every event: a filter of ``bits`` bits a key, kept as bytes, and nothing else."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        field = bytearray(state.get[0] if state.exists else bytes(-(-bits // 8)))
        rows = pd.concat(list(batches), ignore_index=True).sort_values("_order")
        known = []
        for v in map(int, rows["_value"]):
            spots = [(a * v + b) % bits for a, b in hashes]
            known.append(all(field[s >> 3] >> (s & 7) & 1 for s in spots))
            for s in spots:
                field[s >> 3] |= 1 << (s & 7)
        state.update((bytes(field),))
        yield pd.DataFrame({"key": k[0], "event_id": rows["_order"], "value": rows["_value"], "taken_for_seen": known})

    rows = stream.selectExpr(f"{key} AS _key", f"{value} AS _value", "event_id AS _order")
    return rows.groupBy("_key").applyInPandasWithState(step, "key string, event_id bigint, value bigint, taken_for_seen boolean", "field binary", "append", GroupStateTimeout.NoTimeout)
