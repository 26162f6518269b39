"""The control socket as a data source and its replies as a sink.

The source listens at a Unix socket. A connection is one read of 256 bytes at most, numbered from 0, and written to
a journal before the stream hears of it: the number is the offset, so a batch that runs again, also after a restart, gets
the reads that it got before. The sink writes a batch's replies under the batch's number, and does so once: a batch that
is already there is left alone. So no reply is lost or repeated, whatever is interrupted. Clients that still wait get
their reply when the source is next asked for reads, which every trigger does.

    spark.dataSource.register(ControlSocket); spark.dataSource.register(ReplyFolder)
    reads = spark.readStream.format("control_socket").option("socket", "/run/q.sock").option("journal", "file:///shared/j").load()
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

READ_BYTES = 256
#: Connections taken in one batch, at most; the others wait in the socket's queue.
PER_BATCH = 1_000
#: Seconds that a connected client has to say something.
PATIENCE = 0.5
READS = "conn_id long, data binary"
REPLIES = "conn_id long, command string, reply string"


class Folder:
    """Small files of a folder, by any scheme that pyarrow reads. Files appear whole or not at all."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path, recursive=True)

    def put(self, name: str, data: bytes) -> None:
        draft = f"{self.path}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            out.write(data)
        self.fs.create_dir(os.path.dirname(f"{self.path}/{name}"), recursive=True)
        self.fs.move(draft, f"{self.path}/{name}")

    def get(self, name: str) -> bytes | None:
        if self.fs.get_file_info(f"{self.path}/{name}").type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(f"{self.path}/{name}") as of:
            return of.read()

    def names(self, under: str = "") -> list[str]:
        of = fs.FileSelector(f"{self.path}/{under}", allow_not_found=True)
        return sorted(i.base_name for i in self.fs.get_file_info(of) if not i.base_name.startswith("_"))

    def drop(self, name: str) -> None:
        info = self.fs.get_file_info(f"{self.path}/{name}")
        if info.type == fs.FileType.Directory:
            self.fs.delete_dir(info.path)
        elif info.type == fs.FileType.File:
            self.fs.delete_file(info.path)


class ControlReader(SimpleDataSourceStreamReader):
    """Offsets are numbers of reads. It runs beside the driver, one at a time for a socket."""

    def __init__(self, options: dict) -> None:
        self.path, self.journal = options["socket"], Folder(options["journal"])
        self.replies = Folder(options["replies"]) if "replies" in options else None
        self.per_batch = int(options.get("perbatch", PER_BATCH))
        self.listener: socket.socket | None = None
        self.clients: dict[int, socket.socket] = {}
        self.answered = ""  # the last batch of replies that clients were answered from

    def initialOffset(self) -> dict:  # noqa: N802
        return {"reads": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Takes in what is waiting, after what the journal already has from ``start`` on, and answers who can be."""
        self._answer()
        first, known = start["reads"], self._numbers()
        following = known[-1] + 1 if known else 0
        end = max(first, following)
        while end - first < self.per_batch and (data := self._accepted(end)):
            self.journal.put(f"{end:020}", data)
            end += 1
        return self.readBetweenOffsets(start, {"reads": end}), {"reads": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows = [(k, self.journal.get(f"{k:020}")) for k in range(start["reads"], end["reads"])]
        return iter([(k, data) for k, data in rows if data is not None])

    def commit(self, end: dict) -> None:
        """Forgets the reads before ``end`` but for the last, which keeps the count."""
        for k in self._numbers():
            if k < end["reads"] - 1:
                self.journal.drop(f"{k:020}")

    def _numbers(self) -> list[int]:
        return [int(name) for name in self.journal.names()]

    def _answer(self) -> None:
        """Sends replies that have come since to the clients that wait for them."""
        for name in self.replies.names() if self.replies and self.clients else ():
            if name <= self.answered:
                continue
            for line in (self.replies.get(name) or b"").splitlines():
                row = json.loads(line)
                if (client := self.clients.pop(row["conn_id"], None)) is not None:
                    with contextlib.suppress(OSError), client:
                        client.sendall(row["reply"].encode("utf-8"))
            self.answered = name

    def _accepted(self, number: int) -> bytes:
        """One read of the next client that says something; nothing if none waits."""
        if self.listener is None:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(self.path)
            self.listener = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
            self.listener.bind(self.path)
            self.listener.listen(self.per_batch)
            self.listener.setblocking(False)
        while True:
            try:
                client, _ = self.listener.accept()
            except BlockingIOError:
                return b""
            client.settimeout(PATIENCE)
            with contextlib.suppress(OSError):
                if data := client.recv(READ_BYTES):
                    self.clients[number] = client
                    return data
            client.close()


class ControlSocket(DataSource):
    """``control_socket``: conn_id (the number of a read) and data. Options: socket, a path; journal, a folder that survives
    the driver; replies, the folder of a ``reply_folder`` sink, to answer clients from; perBatch."""

    @classmethod
    def name(cls) -> str:
        return "control_socket"

    def schema(self) -> str:
        return READS

    def simpleStreamReader(self, schema) -> ControlReader:  # noqa: ANN001, N802
        return ControlReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Written(WriterCommitMessage):
    draft: str


class ReplyWriter(DataSourceStreamWriter):
    """Tasks write drafts; the driver names them after the batch, unless the batch is there already."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def write(self, iterator: Iterator) -> Written:
        rows = [json.dumps(r.asDict()) for r in iterator]
        draft = f"_drafts/{uuid.uuid4().hex}"
        Folder(self.uri).put(draft, "\n".join(rows).encode("utf-8"))
        return Written(draft)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        folder, drafts = Folder(self.uri), [m.draft for m in messages if m is not None]
        if folder.get(f"{batchId:020}") is None:
            parts = [folder.get(d) or b"" for d in drafts]
            folder.put(f"{batchId:020}", b"\n".join(p for p in parts if p))
        for d in drafts:
            folder.drop(d)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        for m in messages:
            if m is not None:
                Folder(self.uri).drop(m.draft)


class ReplyFolder(DataSource):
    """``reply_folder``: a file of JSON lines for each batch. Option: path, a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "reply_folder"

    def schema(self) -> str:
        return REPLIES

    def streamWriter(self, schema, overwrite: bool) -> ReplyWriter:  # noqa: ANN001, FBT001, N802
        return ReplyWriter(self.options["path"])


def serve(answers: DataFrame, replies: str, checkpoint: str, every: str = "200 milliseconds") -> StreamingQuery:
    """Answers reads (a stream of conn_id, command, reply) for as long as the query runs."""
    return answers.writeStream.format("reply_folder").option("path", replies).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
