"""Bars of CSV files as a data source by name: spark.read.format("bars").option("path", ...).load().

Files are read in ranges of bytes, each a partition, by the driver's and the executors' own file system. Rows that filters
on symbol and times leave out do not reach Spark. What a dialect is, a loader says; more can be registered.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from barlake.bars import PRICES, SchemaError
from barlake.sources.csv_bars import ALIASES, STAMPS, normal, sniff

SCHEMA = "symbol string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double, line long"
ARROW = pa.schema([("symbol", pa.string()), *((c, pa.timestamp("us", "UTC")) for c in ("open_time", "close_time")), *((c, pa.float64()) for c in (*PRICES, "volume")), ("line", pa.int64())])
# Stamp formats that are tried in turn.
FORMATS = ("ISO8601", "%Y.%m.%d %H:%M:%S", "%Y.%m.%d %H:%M", "%d.%m.%Y %H:%M:%S.%f", "%d.%m.%Y %H:%M:%S", "%Y%m%d %H%M%S")
#: Bytes of a partition.
SPLIT = 32 << 20


@dataclass(frozen=True)
class Layout:
    """What a loader finds out from the head of a file: the separator, and which field is which."""

    delimiter: str
    fields: dict[str, int]
    stamp: tuple[int, ...]
    header_bytes: int


class Loader(Protocol):
    """A dialect: how the head of a file tells the layout of its rows."""

    def layout(self, head: bytes, options: dict[str, str]) -> Layout | None:
        """The layout of a file that begins so, or None if it is not of this dialect."""


class DelimitedLoader:
    """Files with a header line that names the fields, in any common separator."""

    def layout(self, head: bytes, options: dict[str, str]) -> Layout | None:
        skip = int(options.get("skiprows", 0))
        lines = head.split(b"\n")
        kept = [x.decode("utf-8-sig").rstrip("\r") for x in lines[skip : skip + 20]]
        if len(lines) <= skip or not kept[0]:
            return None
        delimiter = options.get("delimiter") or sniff([x for x in kept if x])
        names = [ALIASES.get(n := normal(x), n) for x in next(csv.reader([kept[0]], delimiter=delimiter))]
        at = {n: i for i, n in reversed(list(enumerate(names)))}
        stamp = (at["date"], at["time"]) if {"date", "time"} <= at.keys() else tuple(at[s] for s in STAMPS if s in at)[:1]
        if not stamp or not set(PRICES) <= at.keys():
            return None
        return Layout(delimiter, {n: at[n] for n in (*PRICES, "volume") if n in at}, stamp, sum(len(x) + 1 for x in lines[: skip + 1]))


class HeaderlessLoader:
    """Files without a header: stamp, or date and time, then open, high, low, close and volume, as terminals export them."""

    def layout(self, head: bytes, options: dict[str, str]) -> Layout | None:
        lines = [x.decode().rstrip("\r") for x in head.split(b"\n")[:20] if x.strip()]
        if not lines:
            return None
        delimiter = options.get("delimiter") or sniff(lines)
        cells = next(csv.reader([lines[0]], delimiter=delimiter))
        stamps = len(cells) - 5
        if stamps not in (1, 2) or any(c.isalpha() for cell in cells for c in cell if c not in "TZ"):
            return None
        return Layout(delimiter, {n: stamps + i for i, n in enumerate((*PRICES, "volume"))}, tuple(range(stamps)), 0)


#: Tried in turn.
LOADERS: dict[str, Loader] = {"delimited": DelimitedLoader(), "headerless": HeaderlessLoader()}


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int
    layout: Layout


@dataclass
class BarsReader(DataSourceReader):
    options: dict[str, str]
    filters: list[Filter] = field(default_factory=list)

    def files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        if not os.path.isdir(path):
            return [path]
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of times, and of the symbol, are done here; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            times = column in ("open_time", "close_time") and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, datetime)
            if times or (column == "symbol" and isinstance(f, EqualTo)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Part]:
        split, out = int(self.options.get("splitbytes", SPLIT)), []
        tried = [LOADERS[self.options["loader"]]] if "loader" in self.options else list(LOADERS.values())
        for path in self.files():
            with open(path, "rb") as f:
                head = f.read(1 << 16)
            layout = next((x for x in (loader.layout(head, self.options) for loader in tried) if x), None)
            if layout is None:
                raise SchemaError(f"no loader knows the dialect of {path}")
            size = os.path.getsize(path)
            out += [Part(path, a, min(a + split, size), layout) for a in range(layout.header_bytes, size, split)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        """Rows of the lines that begin in the partition's range, in blocks. Files without rows have no partition."""
        if partition is None:
            return
        with open(partition.path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # a line that began before belongs to the range before
            while (at := f.tell()) < partition.end:
                lines = f.readlines(min(1 << 20, partition.end - at))
                keep, place = [], at
                for x in lines:
                    if place >= partition.end:
                        break
                    keep.append(x)
                    place += len(x)
                if table := self.rows(b"".join(keep), at, partition.layout):
                    yield from table.to_batches()
                if place >= partition.end:
                    break

    def rows(self, text: bytes, at: int, layout: Layout) -> pa.Table | None:
        """line is the place of a row's first byte in its file, so that it orders the rows."""
        starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1])
        frame = pd.read_csv(io.BytesIO(text), sep=layout.delimiter, header=None, dtype=str, skipinitialspace=True, skip_blank_lines=False, keep_default_na=False) if text.strip() else None
        if frame is None:
            return None
        frame["line"] = at + starts[: len(frame)]
        stamp = frame[layout.stamp[0]].str.strip()
        for i in layout.stamp[1:]:
            stamp = stamp + " " + frame[i].str.strip()
        frame, stamp = frame[stamp != ""], stamp[stamp != ""]
        time = self.stamps(stamp)
        number = lambda x: pd.to_numeric(x.str.strip().str.replace(".", "", regex=False).str.replace(",", ".", regex=False) if self.options.get("decimal") == "," else x.str.strip(), errors="coerce")
        step = pd.Timedelta(minutes=int(self.options.get("minutes", 5)))
        closes = self.options.get("convention", "open") == "close"
        out = pd.DataFrame({"symbol": self.options.get("symbol", "ALL"), "open_time": time - step if closes else time, "close_time": time if closes else time + step})
        for n in (*PRICES, "volume"):
            out[n] = number(frame[layout.fields[n]]) if n in layout.fields else None
        out["line"] = frame["line"]
        for f in self.filters:
            value = f.value
            if f.attribute[0] != "symbol":
                value = pd.Timestamp(value)
                value = value.tz_localize("UTC") if value.tzinfo is None else value.tz_convert("UTC")
            x = out[f.attribute[0]]
            out = out[x == value if isinstance(f, EqualTo) else x > value if isinstance(f, GreaterThan) else x >= value if isinstance(f, GreaterThanOrEqual) else x < value if isinstance(f, LessThan) else x <= value]
        return pa.Table.from_pandas(out, schema=ARROW, preserve_index=False)

    def stamps(self, text: pd.Series) -> pd.Series:
        """UTC times; naive ones are of the source's zone, of a repeated hour the first pass, of a skipped one an hour later."""
        for form in FORMATS:
            try:
                time = pd.to_datetime(text, format=form, utc=False)
            except ValueError:
                continue
            if getattr(time.dt, "tz", None) is None:
                time = time.dt.tz_localize(self.options.get("source_tz", "UTC"), ambiguous=[True] * len(time), nonexistent=pd.Timedelta(hours=1))
            return time.dt.tz_convert("UTC").astype("datetime64[us, UTC]")
        raise SchemaError(f"unreadable stamps: {text.iloc[:3].tolist()}")


class BarsSource(DataSource):
    """Options: path (a file or a folder), symbol, minutes, convention (open or close), delimiter, decimal, source_tz,
    skiprows, splitbytes, loader."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarsReader:
        if "path" not in self.options:
            raise ValueError("the bars source needs a path")
        return BarsReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes format("bars") known to the session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarsSource)
