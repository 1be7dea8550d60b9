"""Datagrams in and out: capture files, a UDP stream source, a UDP sink.

    spark.dataSource.register(transport.CaptureSource)
    spark.read.format("capture").option("path", folder).load()                    # channel, ingest_ns, datagram
    spark.readStream.format("udp").option("port", 9000).load()                    # the same columns
    df.write.format("udp").option("host", ...).option("port", ...).mode("append").save()   # column datagram

The UDP source reads on the driver, as simple stream readers do, and keeps datagrams until their batch is committed, so
a batch that runs again gets the same rows. For a feed at scale put a log (files, Kafka) in front and use its source."""

from __future__ import annotations

import os
import socket
import struct
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

COLUMNS = "channel int, ingest_ns bigint, datagram binary"
_RECORD, _RECORD_BYTES = ">iqI", 16


def write_capture(path: str, rows: Iterator[tuple[int, int, bytes]]) -> None:
    """A capture file: channel, ingest time and length before every datagram."""
    with open(path, "wb") as f:
        for channel, ingest_ns, datagram in rows:
            f.write(struct.pack(_RECORD, channel, ingest_ns, len(datagram)) + datagram)


class _Whole(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _CaptureReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.listdir(self.path)) if os.path.isdir(self.path) else [""]
        return [_Whole(os.path.join(self.path, n) if n else self.path) for n in names]

    def read(self, partition: _Whole) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            while len(head := f.read(_RECORD_BYTES)) == _RECORD_BYTES:
                channel, ingest_ns, size = struct.unpack(_RECORD, head)
                data = f.read(size)
                if len(data) == size:  # a cut last record is not one
                    yield channel, ingest_ns, data


class CaptureSource(DataSource):
    """Files of datagrams; a file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _CaptureReader(self.options["path"])


class _UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.channel = int(options.get("channel", 0))
        self.most = int(options.get("maxdatagrams", options.get("maxDatagrams", 4096)))
        self.held: dict[int, tuple] = {}
        self.options = options
        self.socket: socket.socket | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"socket": None}

    def _open(self) -> socket.socket:
        """The socket lives where the stream is driven, not where the reader is only described."""
        s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 8 << 20)
        s.bind((self.options.get("host", "127.0.0.1"), int(self.options["port"])))
        if group := self.options.get("group"):
            s.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, socket.inet_aton(group) + socket.inet_aton("0.0.0.0"))
        s.setblocking(False)
        return s

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        self.socket = self.socket or self._open()
        for _ in range(self.most):
            try:
                data = self.socket.recv(65536)
            except BlockingIOError:
                break
            self.held[n] = (self.channel, time.time_ns(), data)
            n += 1
        return self.readBetweenOffsets(start, {"n": n}), {"n": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.held[k] for k in range(start["n"], end["n"]) if k in self.held])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.held if k < end["n"]]:
            del self.held[k]


class _UdpWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.address = options.get("host", "127.0.0.1"), int(options["port"])
        self.at = columns.index("datagram")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            out.setsockopt(socket.IPPROTO_IP, socket.IP_MULTICAST_TTL, 1)
            for row in rows:
                out.sendto(bytes(row[self.at]), self.address)
        return WriterCommitMessage()


class UdpSource(DataSource):
    """A UDP port (group: a multicast group to join) as a stream, and a UDP address as a sink."""

    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return COLUMNS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _UdpReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _UdpWriter(dict(self.options), [f.name for f in schema.fields])
