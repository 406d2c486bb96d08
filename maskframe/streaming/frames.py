"""Event-stream frames out of bytes that are cut anywhere.

A frame ends at a blank line (with or without carriage returns). The state of a response is what has
come of an unfinished frame, as bytes, so a character or a line end may lie across chunks; chunks that
come early wait in a map under their number, and chunks that come again are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from maskframe.streaming.vault import use_store

PIECES = "resp_id string, seq bigint, body binary, final boolean"
FRAMES = "resp_id string, n bigint, event string, data string, frame string, separator string, error_code string"
#: Bytes of an unfinished frame, early chunks included.
MAX_PENDING = 1 << 20
_END = re.compile(rb"\r?\n\r?\n")
_LINE = re.compile(r"\r?\n")


def fields_of(frame: str) -> tuple[str | None, str | None]:
    """The event name and the data lines of a frame; null where it has none."""
    names, data = [], []
    for line in _LINE.split(frame):
        name, colon, value = line.partition(":")
        if colon and name in ("event", "data"):
            (names if name == "event" else data).append(value.removeprefix(" "))
    return (names[-1] if names else None), ("\n".join(data) if data else None)


class Splitter(StatefulProcessor):
    """The state of one response."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.early = handle.getMapState("early", "seq bigint", "body binary, final boolean")
        self.pending = handle.getValueState("pending", "body binary, due bigint, n bigint, waiting bigint, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.pending.exists()
        body, due, n, waiting, ended = self.pending.get() if known else (b"", 0, 0, 0, False)
        # Early chunks are read once; a new response has none, and costs the store one question and one answer.
        early = {int(k[0]): (bytes(v[0]), bool(v[1])) for k, v in self.early.iterator()} if known and not ended else {}
        stored, body, out = set(early), bytearray(body), []
        for part in rows:
            for r in part.itertuples(index=False):
                seq = int(r.seq)
                if not ended and seq >= due and seq not in early:
                    early[seq] = (bytes(r.body or b""), bool(r.final))
                    waiting += len(early[seq][0])
        at = 0
        while not ended and due in early:
            more, final = early.pop(due)
            due, waiting = due + 1, waiting - len(more)
            body += more
            while True:
                m = _END.search(body, at)
                if m is None:
                    at = max(0, len(body) - 3)
                    break
                out.append(self._row(key, n, body[: m.start()], m[0]))
                del body[: m.end()]
                n, at = n + 1, 0
            if final:
                if body:
                    out.append(self._row(key, n, body, b""))
                    n += 1
                body, ended = bytearray(), True
        if not ended and len(body) + waiting > self.most:
            out.append((key[0], n, None, None, None, None, "BUFFER_LIMIT"))
            body, ended = bytearray(), True
        if ended:
            early, waiting = {}, 0
        for seq in stored - set(early):
            self.early.removeKey((seq,))
        for seq in set(early) - stored:
            self.early.updateValue((seq,), early[seq])
        self.pending.update((bytes(body), due, n, waiting, ended))
        made = pd.DataFrame(out, columns=["resp_id", "n", "event", "data", "frame", "separator", "error_code"])
        yield made.astype({"n": "int64"})

    @staticmethod
    def _row(key, n: int, frame: bytes, separator: bytes) -> tuple:
        text = bytes(frame).decode("utf-8", "replace")
        return (key[0], n, *fields_of(text), text, separator.decode(), None)

    def close(self) -> None:
        pass


def frame_stream(pieces: DataFrame, most: int = MAX_PENDING) -> DataFrame:
    """The frames (``FRAMES``) of responses that come as pieces of bytes (``PIECES``, seq from 0).

    Frames of a response are numbered from 0; ``separator`` is what ended it ('' at the end of the
    response). Any cut of the same bytes gives the same frames. Malformed characters become U+FFFD.
    A response whose unfinished part passes ``most`` bytes ends with BUFFER_LIMIT.
    """
    use_store(pieces.sparkSession)
    return pieces.groupBy("resp_id").transformWithStateInPandas(Splitter(most), FRAMES, "Append", "None")
