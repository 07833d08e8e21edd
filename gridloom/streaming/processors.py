"""State of passes and tiles between micro-batches: keyed rows, bounded lists and event-time timers.

Both processors need a state store with column families (``ROCKS`` under ``STORE``). A bucket has one timer at a time: when
it fires too early, because more has come since, it is set anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FRESH = dict(used=0, next_seq=1, closed=False, told=False, budget=0, planned=0, end_seq=0, last_ms=0, n_blocks=0, n_flag=0, n_down=0, n_other=0, noted=[], held=[])
#: Numbers of passes and tiles as text, which keeps them whole beside nulls.
LEDGER_ROWS = "pass_id string, seq long, tile_id string, action string, used_kb long, remaining_kb long"
SUMMARY_ROWS = (
    "pass_id string, tiles_processed long, tiles_flagged long, tiles_downlinked long, tiles_discarded long, "
    "bandwidth_used_kb long, bandwidth_remaining_kb long, flagged_summary array<string>"
)
#: Waiting tiles of a pass lie in rows of so many numbers, or with its account if they are no more; rows leave in frames of so many.
BLOCK, FRAME = 256, 10_000


def _names(layout: str) -> list[str]:
    return [part.split()[0] for part in layout.split(", ")]


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


class PassAccount(StatefulProcessor):
    """Budget accounts of a bucket's passes: tiles in ``seq`` order; early ones wait in the state, ``BLOCK`` numbers to a row.

    A pass ends at its last planned tile or when its budget is used up. Its emptied account stays until the timer, to
    swallow stragglers. The timer runs out ``patience_ms`` after the pass's last event: what still waits is then settled
    and the pass leaves the state. ``summarize``: instead of account rows one row for each pass, on its terminal event
    (``by_event``) or else at its end, with the first ``first`` descriptions of flagged and downlinked tiles.
    """

    def __init__(self, cost_kb: int, patience_ms: int, summarize: bool, by_event: bool, first: int = 10):
        self.cost_kb, self.patience_ms, self.summarize, self.by_event, self.first = cost_kb, patience_ms, summarize, by_event, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accounts = handle.getValueState("accounts", "passes string, timer_ms long")
        self.waiting = handle.getMapState("waiting", "pass string, block long", "seqs array<long>, tiles array<string>, actions array<string>, descriptions array<string>")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict[str | None, dict], int]:
        """Accounts of the bucket's passes and its timer."""
        if not self.accounts.exists():
            return {}, 0
        passes, timer_ms = self.accounts.get()
        return {name: dict(zip(FRESH, values)) for name, *values in json.loads(passes)}, timer_ms

    def _store(self, passes: dict[str | None, dict], timer_ms: int, now: int) -> None:
        """The bucket with a timer for the pass that leaves first; one timer at a time."""
        due = max(min(a["last_ms"] for a in passes.values()) + self.patience_ms, now + 1)
        if not timer_ms or due < timer_ms:
            if timer_ms:
                self.handle.deleteTimer(timer_ms)
            self.handle.registerTimer(due)
            timer_ms = due
        self.accounts.update((json.dumps([(name, *a.values()) for name, a in passes.items()]), timer_ms))

    def _blocks(self, name: str | None) -> list[int]:
        return sorted(block for of, block in self.waiting.keys() if of == (name or ""))

    def _taken(self, name: str | None, block: int) -> dict[int, tuple]:
        """A row of waiting tiles, removed from the state."""
        row = self.waiting.getValue((name or "", block))
        self.waiting.removeKey((name or "", block))
        return {s: rest for s, *rest in zip(*row)}

    def _keep(self, a: dict, name: str | None, early: dict[int, tuple]) -> None:
        a["held"] = []
        if not a["n_blocks"] and len(early) <= BLOCK:
            a["held"] = [(seq, *tile) for seq, tile in early.items()]
            return
        blocks: dict[int, dict[int, tuple]] = {}
        for seq, tile in early.items():
            blocks.setdefault(seq // BLOCK, {})[seq] = tile
        for block, rows in blocks.items():
            if a["n_blocks"] and self.waiting.containsKey((name or "", block)):
                rows = {**self._taken(name, block), **rows}
                a["n_blocks"] -= 1
            seqs = sorted(rows)
            self.waiting.updateValue((name or "", block), (seqs, *map(list, zip(*(rows[s] for s in seqs)))))
            a["n_blocks"] += 1

    def _drop_waiting(self, a: dict, name: str | None) -> None:
        for block in self._blocks(name) if a["n_blocks"] else []:
            self.waiting.removeKey((name or "", block))
        a["n_blocks"], a["held"] = 0, []

    def _settled(self, a: dict, name: str | None, early: dict[int, tuple], gaps: bool) -> Iterator[tuple]:
        """Account rows of all tiles whose turn has come; with ``gaps`` of all that wait."""
        blocks = self._blocks(name) if gaps and a["n_blocks"] else []
        order = sorted(early, reverse=True) if gaps else []
        while not a["closed"]:
            seq = a["next_seq"]
            if seq not in early:
                while order and order[-1] not in early:
                    order.pop()
                if order:
                    seq = order.pop()
                else:
                    block = seq // BLOCK if not gaps else blocks.pop(0) if blocks else -1
                    if not a["n_blocks"] or not self.waiting.containsKey((name or "", block)):
                        return
                    early.update(self._taken(name, block))
                    order = sorted(early, reverse=True) if gaps else []
                    a["n_blocks"] -= 1
                    continue
            tile, action, description = early.pop(seq)
            a["used"] += self.cost_kb if action == "downlink" else 0
            a[{"flag": "n_flag", "downlink": "n_down"}.get(action, "n_other")] += 1
            if self.summarize and action in ("flag", "downlink") and len(a["noted"]) < self.first:
                a["noted"] = [*a["noted"], description]
            a["closed"] = a["used"] >= a["budget"] or seq >= a["planned"] > 0
            a["next_seq"] = seq + 1
            yield (name, seq, tile, action, a["used"], max(0, a["budget"] - a["used"]))

    def _told(self, a: dict, name: str | None, early: dict[int, tuple], gaps: bool) -> Iterator[tuple]:
        """Rows that a pass has to tell now: of its account, or its summary."""
        for row in self._settled(a, name, early, gaps):
            if not self.summarize:
                yield row
        counts = (a["n_flag"], a["n_down"], a["n_other"])
        through = a["closed"] or a["next_seq"] == a["end_seq"]
        if self.summarize and not a["told"] and (gaps and sum(counts) > 0 or (a["end_seq"] > 0 and through if self.by_event else a["closed"])):
            a["told"] = True
            yield (name, sum(counts), *counts, a["used"], max(0, a["budget"] - a["used"]), a["noted"])

    def _framed(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        names = _names(SUMMARY_ROWS if self.summarize else LEDGER_ROWS)
        while frame := list(islice(rows, FRAME)):
            yield pd.DataFrame(frame, columns=names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passes, timer_ms = self._load()
        came: dict[str | None, dict[int, tuple]] = {}
        for pdf in rows:
            for name, seq, at, tile, action, description, budget, planned, ends in zip(
                *(pdf[c].tolist() for c in ("pass_id", "seq", "at_ms", "tile_id", "action", "description", "budget_kb", "tile_count", "ends"))
            ):
                name = _text(name)
                if name not in came:
                    a = passes.setdefault(name, dict(FRESH))
                    came[name] = {s: tuple(rest) for s, *rest in a["held"]}
                a = passes[name]
                a["last_ms"] = max(a["last_ms"], at)
                if ends:
                    a["end_seq"] = int(seq)
                    continue
                a["budget"], a["planned"] = int(budget), int(planned)
                if not a["closed"] and seq >= a["next_seq"]:
                    came[name][int(seq)] = (_text(tile), _text(action), _text(description))

        def told() -> Iterator[tuple]:
            for name, early in came.items():
                a = passes[name]
                yield from self._told(a, name, early, False)
                a["closed"] = a["closed"] or a["told"]
                if a["closed"]:
                    self._drop_waiting(a, name)
                else:
                    self._keep(a, name, early)
                if a["told"]:
                    a["noted"] = []

        yield from self._framed(told())
        self._store(passes, timer_ms, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        passes, _ = self._load()
        due = [name for name, a in passes.items() if a["last_ms"] + self.patience_ms <= now]

        def told() -> Iterator[tuple]:
            for name in due:
                a = passes.pop(name)
                yield from self._told(a, name, {s: tuple(rest) for s, *rest in a["held"]}, True)
                self._drop_waiting(a, name)

        yield from self._framed(told())
        if passes:
            self._store(passes, 0, now)
        else:
            self.accounts.clear()


#: Tiles and passes share the state row of their bucket, so what a batch costs follows its rows and not its keys. The number
#: belongs to a stream's state: it must not change between restarts.
BUCKETS = 4096


class TileFold(StatefulProcessor):
    """Newest value of each event kind of a tile; a row for every batch that changes it. The tiles of a bucket come together.

    An event that comes twice, or after a newer one of its kind, changes nothing. A tile without events for
    ``patience_ms`` leaves the state; should it come back, it starts afresh.
    """

    def __init__(self, kinds: list[str], keys: list[str], patience_ms: int):
        self.kinds, self.keys, self.patience_ms = kinds, keys, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "tiles string, timer_ms long")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict[tuple, list], int]:
        """Tiles of the bucket (newest number and value of each kind, last number, last time) and its timer."""
        if not self.fold.exists():
            return {}, 0
        held, timer_ms = self.fold.get()
        return {tuple(tile): rest for tile, *rest in json.loads(held)}, timer_ms

    def _store(self, tiles: dict[tuple, list], timer_ms: int, now: int) -> None:
        """The bucket with a timer for the tile that leaves first; one timer at a time."""
        due = max(min(last_ms for *_, last_ms in tiles.values()) + self.patience_ms, now + 1)
        if not timer_ms or due < timer_ms:
            if timer_ms:
                self.handle.deleteTimer(timer_ms)
            self.handle.registerTimer(due)
            timer_ms = due
        self.fold.update((json.dumps([(tile, *rest) for tile, rest in tiles.items()]), timer_ms))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        tiles, timer_ms = self._load()
        before: dict[tuple, tuple] = {}
        for pdf in rows:
            named = zip(*([x if isinstance(x, str) else None for x in pdf[k]] for k in self.keys))
            for tile, kind, seq, value, at in zip(named, *(pdf[c].tolist() for c in ("kind", "seq", "value", "at_ms"))):
                if tile not in before:
                    known = tiles.get(tile)
                    if known is None or known[3] + self.patience_ms <= now:  # new, or forgotten by now
                        known = tiles[tile] = [[0] * len(self.kinds), [None] * len(self.kinds), 0, at]
                    before[tile] = (list(known[0]), known[2])
                known = tiles[tile]
                known[2], known[3] = max(known[2], seq), max(known[3], at)
                if seq > known[0][kind]:
                    known[0][kind], known[1][kind] = seq, None if pd.isna(value) else float(value)
        self._store(tiles, timer_ms, now)
        changed = []
        for tile, was in before.items():
            seqs, values, last, _ = tiles[tile]
            if (seqs, last) != was:
                shown = [v if k == 0 or s > seqs[0] else None for k, (s, v) in enumerate(zip(seqs, values))]  # an arrival starts the tile afresh
                changed.append((*tile, seqs[0] > 0, *shown, last))
        for at in range(0, len(changed), FRAME):
            yield pd.DataFrame(changed[at : at + FRAME], columns=[*self.keys, "has_arrived", *self.kinds, "last_seq"]).astype({k: "float64" for k in self.kinds})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, _ = self._load()
        tiles = {tile: rest for tile, rest in held.items() if rest[3] + self.patience_ms > now}
        if tiles:
            self._store(tiles, 0, now)
        else:
            self.fold.clear()
        return iter(())
