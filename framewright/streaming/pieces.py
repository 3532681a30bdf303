"""Files that arrive in pieces, in any number of batches, demuxed with state by path; and sessions that say which rows came late.

A file's state is what a reader would hold: its head once that is known, the bytes that don't fill a packet yet, and the numbers of the
next piece and packet. State is in Spark's state store, so a query that is restarted from its checkpoint goes on in the middle
of a file. Packets are those of the source ``wav`` or ``rawpcm`` for the whole file, however it was cut into pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framewright.operators.packets import PACKET_BYTES
from framewright.sources.riff import FLOAT, PCM, WavError, WavHead, head_of_prefix

PACKETS = "path string, k long, data binary, size long, pts long, channels int, sample_rate long, bit_depth int, format_code int, error string"
_STATE = "seq long, k long, left long, closed boolean, channels int, sample_rate long, bit_depth int, format_code int, block_align int, rest binary"
_UNKNOWN = 1 << 62


class _Demuxer(StatefulProcessor):
    def __init__(self, raw: WavHead | None, limit: int, idle_ms: int | None) -> None:
        self.raw, self.limit, self.idle_ms = raw, limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", _STATE)
        self.early = handle.getListState("early", "seq long, data binary, last boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._load()
        pieces = {x[0]: (bytes(x[1]), x[2]) for x in self.early.get()} if self.early.exists() else {}
        pieces |= {r["seq"]: (bytes(r["data"] or b""), bool(r["last"])) for r in rows}
        ended = False
        while state["seq"] in pieces:
            data, last = pieces.pop(state["seq"])
            state["seq"] += 1
            ended = ended or last
            if not state["closed"]:
                state["rest"] += data
                yield from self._packets(key[0], state)
        if ended and not state["closed"]:
            yield from self._close(key[0], state)
        waiting = [(seq, *x) for seq, x in sorted(pieces.items()) if seq > state["seq"]]
        if waiting:
            self.early.put(waiting)
        elif self.early.exists():
            self.early.clear()
        self._store(state)
        if self.idle_ms is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._load()
        if self.early.exists():
            yield self._row(key[0], state, None, f"piece {state['seq']} is missing")
        elif not state["closed"]:
            yield from self._close(key[0], state)
        self.early.clear()
        self.file.clear()

    def _load(self) -> dict:
        if self.file.exists():
            return dict(zip((c.split()[0] for c in _STATE.split(", ")), self.file.get(), strict=True)) | {"rest": bytes(self.file.get()[-1])}
        head = self.raw or WavHead()
        return {"seq": 0, "k": 0, "left": _UNKNOWN if self.raw else -1, "closed": False, "channels": head.channels, "sample_rate": head.sample_rate, "bit_depth": head.bit_depth, "format_code": head.format_code, "block_align": head.block_align, "rest": b""}

    def _store(self, state: dict) -> None:
        self.file.update(tuple(state.values()))

    def _head(self, state: dict) -> WavHead:
        return WavHead(state["channels"], state["sample_rate"], state["bit_depth"], state["format_code"], block_align=state["block_align"])

    def _packets(self, path: str, state: dict) -> Iterator[Row]:
        """The packets that are whole by now; the head is read as soon as it is."""
        if state["left"] < 0:
            try:
                head = head_of_prefix(state["rest"])
            except WavError as e:
                yield self._row(path, state, None, str(e))
                state |= {"closed": True, "rest": b""}
                return
            if head is None:
                return
            state |= {"left": head.data_size, "channels": head.channels, "sample_rate": head.sample_rate, "bit_depth": head.bit_depth, "format_code": head.format_code, "block_align": head.block_align, "rest": state["rest"][head.data_at :]}
        block = self._head(state).block
        packet = max(block, self.limit - self.limit % block)
        at, rest = 0, state["rest"]
        while min(len(rest) - at, state["left"]) >= packet:
            yield self._row(path, state, rest[at : at + packet])
            state["k"], state["left"], at = state["k"] + 1, state["left"] - packet, at + packet
        state["rest"] = rest[at:]
        if len(state["rest"]) >= state["left"]:
            yield from self._close(path, state)

    def _close(self, path: str, state: dict) -> Iterator[Row]:
        """The rest as the last packet. A file that ends in its head has none."""
        if state["left"] < 0:
            yield self._row(path, state, None, "unexpected EOF")
        elif state["rest"] and state["left"]:
            yield self._row(path, state, state["rest"][: state["left"]])
        state |= {"closed": True, "rest": b"", "left": 0}

    def _row(self, path: str, state: dict, data: bytes | None, error: str | None = None) -> Row:
        if error is not None:
            return Row(path=path, k=state["k"], data=None, size=0, pts=None, channels=None, sample_rate=None, bit_depth=None, format_code=None, error=error)
        head = self._head(state)
        packet = max(head.block, self.limit - self.limit % head.block)
        return Row(path=path, k=state["k"], data=data, size=len(data), pts=head.frames_in(state["k"] * packet), channels=head.channels, sample_rate=head.sample_rate, bit_depth=head.bit_depth, format_code=head.format_code, error=None)


def demuxed(pieces: DataFrame, raw: dict[str, int] | None = None, limit: int = PACKET_BYTES, idle_ms: int | None = None) -> DataFrame:
    """Packets of files whose pieces are rows of a stream: path, seq (0, 1, ...), data, last.

    Pieces may come in any order and more than once: a piece waits for those before it, one that was there is passed over. A file
    is closed by its ``last`` piece, by the end of the data that its head declares, or with ``idle_ms`` after that time without a piece; its rest is
    then its last packet. Only an idle file's state goes: later pieces of a closed one are still passed over. What can't be read is a row with an ``error`` and no data: a bad head, a file that
    ends within it, a piece that never came. Null data is an empty piece, a null path a file of its own. ``raw`` (channels, sample_rate, depth) reads
    headless PCM. With ``idle_ms`` Spark runs batches without rows as well, so the query needs a trigger
    that goes on (``availableNow`` would not end). One file's pieces are worked
    through by one task, as its packets follow from each other.
    """
    head = None
    if raw is not None:
        head = WavHead(raw["channels"], raw["sample_rate"], raw["depth"], FLOAT if raw["depth"] == 32 else PCM)
        if head.error():
            raise WavError(head.error())
    return pieces.select("path", "seq", "data", "last").groupBy("path").transformWithState(_Demuxer(head, limit, idle_ms), PACKETS, "Append", "None" if idle_ms is None else "ProcessingTime")


class _Sessions(StatefulProcessor):
    """Open sessions of a key, and the newest time that earlier batches had."""

    def __init__(self, gap_ms: int, late_ms: int) -> None:
        self.gap, self.late = gap_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long")
        self.open = handle.getListState("open", "start long, end long, n long, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        spans = [list(x) for x in self.open.get()] if self.open.exists() else []
        top = newest
        for at, size in sorted((r["at"], r["size"] or 0) for r in rows if r["at"] is not None):
            if newest is not None and at < newest - self.late:
                yield self._row(key[0], at, at, 1, size, True)
                continue
            spans.append([at, at + self.gap, 1, size])
            top = at if top is None else max(top, at)
        joined: list[list[int]] = []
        for x in sorted(spans):
            if joined and x[0] <= joined[-1][1]:
                last = joined[-1]
                last[1], last[2], last[3] = max(last[1], x[1]), last[2] + x[2], last[3] + x[3]
            else:
                joined.append(x)
        if top is None:
            return
        for x in joined:
            if x[1] < top - self.late:
                yield self._row(key[0], *x, False)
        left = [tuple(x) for x in joined if x[1] >= top - self.late]
        self.newest.update((top,))
        if left:
            self.open.put(left)
        elif self.open.exists():
            self.open.clear()

    @staticmethod
    def _row(key, start: int, end: int, n: int, total: int, late: bool) -> Row:
        return Row(key=key, start=start, end=end, n=n, total=total, late=late)


def sessions_and_late(events: DataFrame, key: str, at_ms: str, size: str, gap_ms: int, late_ms: int) -> DataFrame:
    """key, start, end, n, total, late: closed sessions of a stream, and each row that came too late as a row of its own (late is true).

    Spark drops what is behind its watermark; here it is an output. Times are in milliseconds. A key has a watermark of its own: the newest time of
    the batches before, less ``late_ms``; a row behind it is late whatever other keys do, a session that ends before
    it is closed. A gap right as long as ``gap_ms`` joins. Rows without a time go, a null size is 0. Open sessions of a key that is
    never seen again stay in the state.
    """
    slim = events.selectExpr(f"{key} as key", f"cast({at_ms} as long) as at", f"cast({size} as long) as size")
    kind = slim.schema["key"].dataType.simpleString()
    out = slim.groupBy("key").transformWithState(_Sessions(gap_ms, late_ms), f"key {kind}, start long, end long, n long, total long, late boolean", "Append", "None")
    return out.withColumnRenamed("key", key)
