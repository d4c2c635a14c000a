"""Binary event logs: decoding, and encoding for tests and round trips.

A record begins with the id of its static event; what follows depends on the event's kind. Numbers of any size are a length
byte and that many big-endian bytes. DEF: variable id, pickled value with a 4-byte length, type name with a 2-byte length.
FUNCTION_EXIT: value and type name. CONDITION: one byte. USE, TEST_USE, TEST_DEF: variable id. LEN: variable id and length.

A log that breaks off ends without an error, as a killed run leaves it. Pickles are read by the few opcodes that scalars
need; nothing is ever constructed from them.
"""

from __future__ import annotations

import struct
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored

#: A mapping describes a program's source, not its runs; a larger one isn't broadcast, but joined.
MAPPING_ROWS = 2_000_000
#: Events of a run in one log.
STRETCH = 65_536
#: Records of a batch; logs of a batch, and their bytes.
BATCH, LOGS, LOG_BYTES = 50_000, 1_000, 4 << 20
_COLUMNS = [("seq", pa.int64()), ("event_id", pa.int64()), ("var_id", pa.int64()), ("value_num", pa.float64()), ("value_str", pa.string()), ("value_bin", pa.binary()), ("value_bool", pa.bool_()), ("value_type", pa.string()), ("length", pa.int64())]
DYNAMIC = "seq long, event_id long, var_id long, value_num double, value_str string, value_bin binary, value_bool boolean, value_type string, length long"


def put_number(n: int) -> bytes:
    body = n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")
    return bytes([len(body)]) + body


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return int.from_bytes(self.take(self.take(1)[0]), "big")

    def sized(self, width: int) -> bytes:
        return self.take(int.from_bytes(self.take(width), "big"))


def read_scalar(data: bytes) -> object:
    """The scalar of a protocol-4 pickle; ValueError for anything else."""
    r, stack = Reader(data), []
    while True:
        op = r.take(1)
        if op == b"\x80":
            r.take(1)
        elif op == b"\x95":
            r.take(8)
        elif op == b"\x94":
            continue
        elif op == b".":
            return stack.pop()
        elif op in b"N\x88\x89":
            stack.append({b"N": None, b"\x88": True, b"\x89": False}[op])
        elif op in b"KM":
            stack.append(int.from_bytes(r.take(1 if op == b"K" else 2), "little"))
        elif op == b"J":
            stack.append(int.from_bytes(r.take(4), "little", signed=True))
        elif op == b"\x8a":
            stack.append(int.from_bytes(r.take(r.take(1)[0]), "little", signed=True))
        elif op == b"G":
            stack.append(struct.unpack(">d", r.take(8))[0])
        elif op == b"\x8c":
            stack.append(r.take(r.take(1)[0]).decode())
        elif op == b"X":
            stack.append(r.take(int.from_bytes(r.take(4), "little")).decode())
        elif op in b"CB":
            stack.append(r.take(int.from_bytes(r.take(1 if op == b"C" else 4), "little")))
        else:
            raise ValueError(f"opcode {op!r}")


def write_scalar(value: object) -> bytes:
    import pickle

    if not isinstance(value, int | float | str | bytes | bool | None):
        raise TypeError("scalars only")
    return pickle.dumps(value, protocol=4)


def value_columns(value: object, kind: str | None) -> dict:
    row = {"value_num": None, "value_str": None, "value_bin": None, "value_bool": None, "value_type": kind}
    if isinstance(value, bool):
        row |= {"value_bool": value, "value_num": float(value)}
    elif isinstance(value, int | float):
        try:
            row["value_num"] = float(value)
        except OverflowError:
            row["value_str"] = str(value)
    elif isinstance(value, str):
        row["value_str"] = value
    elif isinstance(value, bytes):
        row["value_bin"] = value
    return row


Record = tuple[int, str, int | None, int | None, bytes | None, str | None, bool | None]


def records(r: Reader, kinds: dict[int, str]) -> Iterator[Record]:
    """(event, kind, variable id, length, pickled value, type name, truth) of a log's records, up to where it breaks off; those of events
    that aren't in the mapping end it too. The reader stands at the end of the last whole record then."""
    whole = r.at
    try:
        while r.at < len(r.data):
            event = r.number()
            kind = kinds[event]
            var_id = r.number() if kind in ("DEF", "USE", "TEST_USE", "TEST_DEF", "LEN") else None
            length = r.number() if kind == "LEN" else None
            raw, name = (r.sized(4), r.sized(2).decode()) if kind in ("DEF", "FUNCTION_EXIT") else (None, None)
            truth = r.take(1) != b"\0" if kind == "CONDITION" else None
            whole = r.at
            yield event, kind, var_id, length, raw, name, truth
    except (EOFError, KeyError, ValueError, IndexError):
        pass
    r.at = whole


def decode(data: bytes, kinds: dict[int, str]) -> Iterator[dict]:
    """The records of a log as rows; a value that is no scalar ends it."""
    try:
        for seq, (event, _, var_id, length, raw, name, truth) in enumerate(records(Reader(data), kinds), 1):
            row = {"seq": seq, "event_id": event, "var_id": var_id, "length": length} | value_columns(read_scalar(raw) if raw else None, name)
            yield row if truth is None else row | {"value_bool": truth}
    except (EOFError, ValueError, IndexError):
        return


@lru_cache(1 << 16)
def _short_values(raw: bytes) -> tuple:
    return _values(raw)


def _values(raw: bytes | None) -> tuple:
    return tuple(value_columns(read_scalar(raw) if raw else None, None).values())[:4]


def value_rows(data: bytes, kinds: dict[int, str], wanted: set[str] | None = None, reader: Reader | None = None) -> Iterator[tuple]:
    """As decode(), in the order of DYNAMIC: tuples of the wanted kinds only, whose numbers are those of all records."""
    try:
        for seq, (event, kind, var_id, length, raw, name, truth) in enumerate(records(reader or Reader(data), kinds), 1):
            if wanted is None or kind in wanted:
                num, text, body, true = (_short_values if raw and len(raw) < 64 else _values)(raw)
                yield seq, event, var_id, num, text, body, true if truth is None else truth, name, length
    except (EOFError, ValueError, IndexError):
        return


def encode_record(kind: str, event_id: int, var_id: int = 0, raw: bytes = b"", type_name: str = "", truth: bool = False, length: int = 0) -> bytes:
    out = put_number(event_id)
    if kind in ("DEF", "USE", "TEST_USE", "TEST_DEF", "LEN"):
        out += put_number(var_id)
    if kind == "LEN":
        out += put_number(length)
    if kind in ("DEF", "FUNCTION_EXIT"):
        out += struct.pack(">i", len(raw)) + raw + struct.pack(">h", len(type_name.encode())) + type_name.encode()
    if kind == "CONDITION":
        out += bytes([truth])
    return out


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def possible_ids(data: bytes) -> np.ndarray:
    """Every number that can be read at some byte of a log: its events' ids are among them."""
    raw = np.frombuffer(data, dtype=np.uint8)
    found = [np.zeros(min(1, int((raw == 0).sum())), dtype=np.uint64)]
    for n in range(1, 9):
        at = np.flatnonzero(raw[: max(len(raw) - n, 0)] == n)
        value = np.zeros(len(at), dtype=np.uint64)
        for i in range(1, n + 1):
            value = value << np.uint64(8) | raw[at + i]
        found.append(value)
    long = [(at, int(raw[at])) for at in np.flatnonzero(raw > 8).tolist() if at + 1 < len(raw) and not raw[at + 1]]
    wide = [int.from_bytes(data[at + 1 : at + 1 + n], "big") for at, n in long if at + 1 + n <= len(raw) and not any(data[at + 1 : at + n - 7])]
    every = np.unique(np.concatenate([*found, np.array(wide, dtype=np.uint64)]))
    return every[every < np.uint64(2**63)].astype(np.int64)


def with_kinds(logs: DataFrame, mapping: DataFrame) -> DataFrame:
    """logs with ids and kinds, of the mapping's events that each log may hold. Nothing of the mapping is collected."""
    named = logs.withColumn("_log", F.xxhash64(*logs.columns))  # logs of one hash share their kinds, which does no harm

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for log, content in zip(pdf["_log"], pdf["content"], strict=True):
                yield pd.DataFrame({"event_id": possible_ids(bytes(content))}).assign(_log=log)

    ids = named.select("_log", "content").mapInPandas(find, "event_id long, _log long").distinct()
    known = ids.join(mapping.select("event_id", "event_type"), "event_id").groupBy("_log").agg(F.collect_list(F.struct("event_id", "event_type")).alias("k"))  # no larger than the log
    return named.join(known.select("_log", F.col("k.event_id").alias("_ids"), F.col("k.event_type").alias("_kinds")), "_log").drop("_log")


def decode_logs(logs: DataFrame, mapping: DataFrame, most: int = MAPPING_ROWS) -> DataFrame:
    """logs: content, beside columns that tell the run. mapping: event_id, event_type and the static columns. All events,
    in the order of seq within a log, with static and dynamic columns. A mapping of over most rows is joined in Spark."""
    mapping = stored(mapping, "mapping")  # read three times
    small = most > 0 and mapping.limit(most + 1).count() <= most
    kinds = {r.event_id: r.event_type for r in mapping.select("event_id", "event_type").collect()} if small else None
    shared = logs.sparkSession.sparkContext.broadcast(kinds)
    keys = [f for f in logs.schema.fields if f.name != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(batch.schema.get_field_index("content"))
            own = [shared.value] * len(contents) if small else (dict(zip(i, k, strict=True)) for i, k in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True))
            rows: list[tuple] = []
            full = lambda: _batch(batch, rows, [k.name for k in keys])  # noqa: B023, E731
            for at, (content, known) in enumerate(zip(contents, own, strict=True)):
                for record in value_rows(content.as_py(), known):
                    rows.append((at, *record))
                    if len(rows) == BATCH:
                        yield full()
                        rows = []
            if rows:
                yield full()

    schema = ", ".join([*(f"`{k.name}` {k.dataType.simpleString()}" for k in keys), DYNAMIC])
    found = (logs if small else with_kinds(logs, mapping)).mapInArrow(run, schema)
    return found.join(F.broadcast(mapping) if small else mapping, "event_id")


def _batch(logs: pa.RecordBatch, rows: list[tuple], keys: list[str]) -> pa.RecordBatch:
    """Rows as columns, beside the columns that tell their logs; a row begins with its log's place in the batch."""
    at, *columns = zip(*rows, strict=True)
    which = pa.array(at, pa.int64())
    own = [logs.column(logs.schema.get_field_index(k)).take(which) for k in keys]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True))], names=[*keys, *(n for n, _ in _COLUMNS)])


def encode_logs(events: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """run_id, chunk and content: logs of a run's events by stretches of their seq (from 1), so that no run is one task's.
    Values are those that value_type names: str, bytes, bool, int (value_str where a double can't hold it), else float or None."""
    absent = lambda x: x is None or x != x

    def value_of(e: tuple) -> object:
        if e.value_type == "str":
            return e.value_str
        if e.value_type == "bytes":
            return None if e.value_bin is None else bytes(e.value_bin)
        if e.value_type == "bool":
            return None if absent(e.value_bool) else bool(e.value_bool)
        if absent(e.value_num):
            return int(e.value_str) if e.value_type == "int" and e.value_str else None
        return int(e.value_num) if e.value_type == "int" else float(e.value_num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, held, logs = None, [], 0, []
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*logs, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["run_id", "chunk", "content"])
        for batch in batches:
            for e in map(Row._make, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if last != (e.run_id, e.chunk):
                    if last is not None:
                        logs.append((*last, b"".join(parts)))
                        held += len(logs[-1][2])
                    if held > LOG_BYTES or len(logs) == LOGS:
                        yield full()
                        held, logs = 0, []
                    last, parts = (e.run_id, e.chunk), []
                raw = write_scalar(value_of(e)) if e.event_type in ("DEF", "FUNCTION_EXIT") else b""
                parts.append(encode_record(e.event_type, e.event_id, e.var_id or 0, raw, e.value_type or "", bool(e.value_bool), e.length or 0))
        if last is not None:
            logs.append((*last, b"".join(parts)))
            yield full()

    rows = events.select("run_id", F.floor((F.col("seq") - 1) / stretch).alias("chunk"), "seq", "event_type", "event_id", "var_id", "value_num", "value_str", "value_bin", "value_type", "value_bool", "length")
    Row = namedtuple("Row", rows.columns)  # noqa: N806
    return rows.repartition("run_id", "chunk").sortWithinPartitions("run_id", "chunk", "seq").mapInArrow(run, "run_id long, chunk long, content binary")
