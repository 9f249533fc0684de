"""The replay buffer as a stream: keyed state with a version watermark, expiry and capacity eviction.

Each buffer_id is one key, so its records are applied in order by one writer; buffers run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from embertide.functions.decay import Decay

EVENTS = "buffer_id long, seq long, op string, slot long, q long, version long, reason string"
STATE = "version long, slots array<long>, qs array<long>, versions array<long>, seqs array<long>"


class Buffer:
    """Slots of one buffer. Changes come back as (op, slot, q, version, reason) rows."""

    def __init__(self, decay: Decay, version: int = 0, live: dict[int, tuple[int, int, int]] | None = None):
        self.decay, self.version, self.live = decay, version, dict(live or {})

    def advance(self, version: int) -> list[tuple]:
        """Move the watermark; expired entries leave in slot order. A lower version is an error."""
        if version < self.version:
            raise ValueError(f"version {version} is behind {self.version}")
        self.version = version
        gone = sorted(s for s, (_, v, _) in self.live.items() if version - v > self.decay.max_age)
        return [self._leave(s, "stale") for s in gone]

    def _leave(self, slot: int, reason: str) -> tuple:
        q, v, _ = self.live.pop(slot)
        return ("evict", slot, q, v, reason)

    def add(self, qs: list[int], version: int, seq: int) -> list[tuple]:
        """Insert a group: advance first, make room by age, fill the lowest free slots.

        A late group is refused whole if it has expired, or if room for it would take a newer entry.
        """
        if len(qs) > self.decay.capacity:
            return [("refuse", None, None, version, "larger than the buffer")]
        out = self.advance(version) if version > self.version else []
        if self.version - version > self.decay.max_age:
            return [*out, ("refuse", None, None, version, "expired")]
        short = len(self.live) + len(qs) - self.decay.capacity
        if short > 0:
            leaving = sorted(self.live, key=lambda s: (self.live[s][1], self.live[s][2], s))[:short]
            if any(self.live[s][1] > version for s in leaving):
                return [*out, ("refuse", None, None, version, "would evict newer entries")]
            out += [self._leave(s, "capacity") for s in leaving]
        free = (s for s in range(self.decay.capacity) if s not in self.live)
        for i, q in enumerate(qs):
            slot = next(free)
            self.live[slot] = (q, version, seq * self.decay.capacity + i)
            out.append(("insert", slot, q, version, None))
        return out

    def update(self, slots: list[int], qs: list[int]) -> list[tuple]:
        """New priorities of live slots, all checked before any is written; the last of a slot wins."""
        if len(slots) != len(qs) or any(s not in self.live for s in slots):
            return [("refuse", None, None, self.version, "update of an empty slot")]
        out = []
        for s, q in zip(slots, qs, strict=True):
            _, v, order = self.live[s]
            self.live[s] = (q, v, order)
            out.append(("update", s, q, v, None))
        return out

    def evict(self, slots: list[int], reason: str) -> list[tuple]:
        return [self._leave(s, reason) for s in sorted(set(slots)) if s in self.live]


def run_buffers(commands: DataFrame, decay: Decay) -> DataFrame:
    """Changes made by a stream of commands (buffer_id, seq, op, version, slots, qs).

    op is add, advance, update, evict or quarantine. Commands of a micro-batch apply by seq;
    a seq that a buffer has seen is skipped, so replays after a failure change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = -1
        if state.exists:
            version, slots, qs, versions, seqs = state.get
            seen, seqs = seqs[-1], seqs[:-1]
            buffer = Buffer(decay, version, {s: (q, v, o) for s, q, v, o in zip(slots, qs, versions, seqs, strict=True)})
        else:
            buffer = Buffer(decay)
        rows = []
        commands = pd.concat(list(batches)).sort_values("seq")
        for c in commands.itertuples():
            if c.seq <= seen:
                continue
            seen = int(c.seq)
            if c.op == "add":
                out = buffer.add([int(q) for q in c.qs], int(c.version), seen)
            elif c.op == "advance":
                late = c.version < buffer.version
                out = [("refuse", None, None, int(c.version), "behind the watermark")] if late else buffer.advance(int(c.version))
            elif c.op == "update":
                out = buffer.update([int(s) for s in c.slots], [int(q) for q in c.qs])
            elif c.op in ("evict", "quarantine"):
                out = buffer.evict([int(s) for s in c.slots], "explicit" if c.op == "evict" else "quarantine")
            else:
                out = [("refuse", None, None, buffer.version, "unknown command")]
            rows += [(key[0], seen, *x) for x in out]
        live = buffer.live
        order = [live[s][2] for s in live]
        state.update((buffer.version, list(live), [live[s][0] for s in live], [live[s][1] for s in live], [*order, seen]))
        names = ["buffer_id", "seq", "op", "slot", "q", "version", "reason"]
        frame = pd.DataFrame(rows, columns=names)
        for n in ("slot", "q", "version"):
            frame[n] = pd.array([None if r[names.index(n)] is None else int(r[names.index(n)]) for r in rows], "Int64")
        yield frame

    return commands.groupBy("buffer_id").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def commands_of_files(spark, folder: str) -> DataFrame:
    """A stream of command files (JSON lines) in a folder."""
    schema = "buffer_id long, seq long, op string, version long, slots array<long>, qs array<long>"
    return spark.readStream.schema(schema).json(folder)


def start(commands: DataFrame, decay: Decay, out: str, checkpoint: str):
    """Write changes as Parquet, exactly once by the file sink and the checkpoint."""
    return run_buffers(commands, decay).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(out)
