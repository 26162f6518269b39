"""Schemas of the frame, capability and report vocabulary, and checks of their invariants.

Sum types are structs of a tag and the fields of each case, null where a case lacks them. Unsigned 32-bit
numbers are bigint; instants are bigint nanoseconds of a monotone clock, not timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SURFACE_SIZE = "struct<width:bigint,height:bigint>"
GEOMETRY = "struct<x:int,y:int,width:bigint,height:bigint,scale:double>"
CPU_BUFFER = "struct<data:binary,width:bigint,height:bigint,stride:bigint>"
DAMAGE = "struct<tag:string,rects:array<struct<x:int,y:int,width:int,height:int>>>"
FRAME_REQUEST = f"struct<target_size:{SURFACE_SIZE},is_first_frame:boolean,clock_ns:bigint,frame_index:bigint>"
FRAME_OUTPUT = f"struct<tag:string,buffer:{CPU_BUFFER},damage:{DAMAGE},reason:string>"
BACKEND_CAPABILITIES = "struct<source_kind:string,resize:string,pause_semantics:string,content_type_hint:string>"
NEGOTIATION = "struct<tag:string,notes:array<string>,error:struct<reason:string,renderer_supports:string,backend_requires:string>>"
LOAD_REPORT = "struct<status:string,severity:string,warnings:array<string>,ignored:array<string>,stats:struct<total_bytes:bigint,image_count:int>>"
HYPOTHESIS = "struct<label:string,source_type:string,value:int,scope_operator:string,support:array<string>,active:boolean>"
#: The four separate entities around a profile: what is drawn, how, when, and what happens besides.
PROFILE = "name string, outputs map<string,struct<path:string,backend:string,fit:string>>"
RUNTIME_POLICY = "name string, pause_on_fullscreen boolean"
ACTIVATION = "name string, seq long"
HOOK = "name string, event string, action string"
#: The cases of each enumeration.
ENUMS = {
    "source_kind": ("CpuRgba", "DeviceEncoded", "Static"), "resize": ("Immediate", "Deferred"), "pause_semantics": ("Freeze", "LogicOnly", "Unsupported"), "content_type_hint": ("None", "Photo"),
    "backend_status": ("Ready", "Degraded", "Failed", "Paused"), "renderer_status": ("Ready", "SurfaceLost", "DeviceLost"), "present_error": ("SurfaceLost", "DeviceLost", "Transient"),
    "present_outcome": ("Presented", "Skipped"), "surface_format": ("Bgra8Unorm", "Rgba8Unorm"), "frame_output": ("Cpu", "DeviceEncoded", "Unchanged", "SkippedDegraded"),
    "damage": ("Full", "Partial", "Empty"), "phase": ("Created", "Prepared", "Rendering", "Paused", "Failed"), "load_status": ("Ok", "Partial", "Failed"), "severity": ("Cosmetic", "Visible", "Major"),
}


def is_case(value: Column, enum: str) -> Column:
    return F.coalesce(value.isin(*ENUMS[enum]), F.lit(False))


def frame_output_fault(output: Column) -> Column:
    """Which invariant a frame output breaks, else null: its tag is a case, a CPU frame has a buffer of 4 x
    width x height bytes, rows of 4 x width bytes and a damage, a skipped one says why."""
    b, cpu = output["buffer"], output["tag"] == "Cpu"
    return (
        F.when(~is_case(output["tag"], "frame_output"), "tag")
        .when(cpu & (b.isNull() | (F.octet_length(b["data"]) != b["width"] * b["height"] * 4)), "length")
        .when(cpu & (b["stride"] != b["width"] * 4), "stride")
        .when(cpu & ~is_case(output["damage"]["tag"], "damage"), "damage")
        .when((output["tag"] == "SkippedDegraded") & (F.coalesce(F.length(output["reason"]), F.lit(0)) == 0), "reason")
    )


def millis_to_ns(millis: Column) -> Column:
    return (millis * 1_000_000).cast("bigint")
