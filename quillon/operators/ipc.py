"""Commands of the control socket: plain words, and requests in JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import trimmed

READ_BYTES = 256
#: Requests of the JSON protocol.
VERBS = ("SetProfile", "GetActiveProfile", "ListProfiles", "GetOutputs", "Pause", "Resume", "Reload", "Ping")
#: Command lines and the request that each stands for.
CLI = {"profile set": "SetProfile", "output list": "GetOutputs", "status": "GetActiveProfile", "diag": "Diag"}


def decoded(data: Column) -> Column:
    """The text of one read: 256 bytes at most, empty if they are not UTF-8."""
    read = F.substring(data.cast("binary"), 1, READ_BYTES)
    return F.coalesce(F.when(F.is_valid_utf8(read.cast("string")), read.cast("string")), F.lit(""))


def route(commands: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``commands`` (key, order, raw) that are handled, with ``command``, ``handled`` (their running number) and
    ``reply``.

    Empty and null reads are not handled. Nothing is after a key's first quit, which itself is answered."""
    cmd = trimmed(F.col("raw"))
    out = commands.where(F.length("raw") > 0).withColumn("command", cmd)
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((F.col("command") == "quit").cast("int")).over(before), F.lit(0))
    out = out.withColumn("__stopped", stopped).where("__stopped = 0").drop("__stopped")
    out = out.withColumn("handled", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out.withColumn("reply", reply(F.col("command"), F.col("handled")))


def reply(command: Column, handled: Column, frames: Column | None = None, animate: Column | None = None) -> Column:
    """The reply's text. Uptime is a matter of the clock and left out of the status line."""
    frames = F.lit(0) if frames is None else frames
    animate = F.lit(True) if animate is None else animate
    status = F.concat(F.lit("frames="), frames.cast("string"), F.lit(" animate="), animate.cast("string"), F.lit(" ipc_commands="), handled.cast("string"), F.lit("\n"))
    return (
        F.when(command == "ping", "pong\n").when(command == "status", status).when(command == "quit", "bye\n")
        .otherwise(F.concat(F.lit("error: unknown command '"), command, F.lit("'\n")))
    )


def json_requests(requests: DataFrame) -> DataFrame:
    """``requests`` (raw) with ``verb``, ``argument`` and ``error``: malformed JSON and unknown verbs are error rows."""
    body = F.from_json("raw", "cmd string, arg string")
    out = requests.withColumn("__b", body)
    known = F.col("__b.cmd").isin(*VERBS)
    error = F.when(F.col("__b.cmd").isNull(), "malformed request").when(~known, F.concat(F.lit("unknown request "), F.col("__b.cmd")))
    return out.withColumns({"verb": F.when(known, F.col("__b.cmd")), "argument": F.col("__b.arg"), "error": error}).drop("__b")


def cli_verb(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for words, verb in CLI.items():
        out = F.when((line == words) | line.startswith(words + " "), verb).otherwise(out)
    return out
