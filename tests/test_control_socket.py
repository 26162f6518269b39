"""The control socket end to end: clients, restarts, batches that run twice."""

import json
import socket
import threading
import time
from pathlib import Path

import pytest

from quillon.streaming import ipc
from quillon.streaming.control_socket import ControlReader, ControlSocket, Folder, ReplyFolder, ReplyWriter, serve


def ask(path, text, wait=30):
    """What a client gets for a text."""
    until = time.time() + wait
    while True:
        try:
            client = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
            client.connect(path)
            break
        except OSError:
            assert time.time() < until
            time.sleep(0.1)
    with client:
        client.settimeout(wait)
        client.sendall(text)
        return client.recv(4_096)


def lines(folder):
    return [json.loads(x) for f in sorted(Path(folder).glob("0*")) for x in f.read_text().splitlines()]


@pytest.fixture
def service(spark, tmp_path):
    spark.dataSource.register(ControlSocket)
    spark.dataSource.register(ReplyFolder)
    names = {"socket": str(tmp_path / "s"), "journal": f"file://{tmp_path}/journal", "replies": f"file://{tmp_path}/replies"}

    def start():
        reads = spark.readStream.format("control_socket").options(**names).load()
        return serve(ipc.replies(reads), names["replies"], str(tmp_path / "checkpoint"))

    return start, names, tmp_path


def test_clients_get_replies_and_restarts_lose_and_repeat_none(service):
    start, names, at = service
    asked = [b"ping\n", b" status ", b"\xff\xfe", b"x" * 300, b"quit"]
    said = {}
    query = start()
    try:
        threads = [threading.Thread(target=lambda k=k, t=t: said.update({k: ask(names["socket"], t)})) for k, t in enumerate(asked)]
        for t in threads:
            t.start()
        for t in threads:
            t.join(60)
    finally:
        query.stop()
    assert said[0] == b"pong\n" and said[4] == b"bye\n" and said[2] == b"error: unknown command ''\n"
    assert said[3] == b"error: unknown command '" + b"x" * 256 + b"'\n" and said[1].startswith(b"frames=0 animate=true ipc_commands=")
    before = lines(at / "replies")
    assert sorted(r["conn_id"] for r in before) == [0, 1, 2, 3, 4]
    # the last batch is forgotten, as if the driver had died after writing it: it runs again
    commits = sorted((at / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink()
    query = start()
    try:
        assert ask(names["socket"], b"ping") == b"pong\n"
    finally:
        query.stop()
    after = lines(at / "replies")
    assert after[: len(before)] == before and [r["conn_id"] for r in after[len(before) :]] == [5]


def test_journal_replays_reads_and_keeps_the_count(tmp_path):
    of = {"socket": str(tmp_path / "s"), "journal": f"file://{tmp_path}/j", "perbatch": "2"}
    reader = ControlReader(of)
    assert reader.read(reader.initialOffset())[1] == {"reads": 0}
    clients = []
    for k in range(3):
        client = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        client.connect(of["socket"])
        client.sendall(b"c%d" % k)
        clients.append(client)
    rows, end = reader.read({"reads": 0})
    assert list(rows) == [(0, b"c0"), (1, b"c1")] and end == {"reads": 2}
    again = ControlReader(of)
    assert list(again.readBetweenOffsets({"reads": 0}, {"reads": 2})) == [(0, b"c0"), (1, b"c1")]
    rows, end = reader.read({"reads": 2})
    assert list(rows) == [(2, b"c2")] and end == {"reads": 3}
    reader.commit({"reads": 3})
    assert ControlReader(of).read({"reads": 3})[1] == {"reads": 3} and len(list((tmp_path / "j").iterdir())) == 1


def test_a_batch_is_written_once(tmp_path):
    class Row(dict):
        asDict = dict.copy  # noqa: N815

    writer, uri = ReplyWriter(f"file://{tmp_path}/r"), f"file://{tmp_path}/r"
    for reply in ("one", "two"):
        message = writer.write(iter([Row(conn_id=1, command="c", reply=reply)]))
        writer.commit([message, None], 7)
    writer.abort([writer.write(iter([Row(conn_id=2, command="c", reply="x")]))], 8)
    assert [r["reply"] for r in lines(tmp_path / "r")] == ["one"] and Folder(uri).names() == [f"{7:020}"] and not list((tmp_path / "r/_drafts").iterdir())
