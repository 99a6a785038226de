"""Functions of industrial protocols: what a control-plane log row does, by the protocol of its log and its function.

A protocol is a table: the fields that name the function, exact names, and patterns tried in turn, each with an action
and an operation (read, write, control or other). One expression is made of it, so that a row costs one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ip import bind
from logweave.sources.event import lookup

Get = Callable[..., Column]


@dataclass(frozen=True)
class Protocol:
    """prefix is that of the action of a function no pattern knows, otherwise the action of a row without a function;
    dashed are the characters that become dashes there; numbered is the action of an unknown number."""

    fields: tuple[str, ...] = ()
    exact: dict[str, tuple[str, str]] = field(default_factory=dict)
    patterns: tuple[tuple[str, str, str], ...] = ()
    prefix: str = ""
    otherwise: str = "ot-request"
    dashed: str = ""
    numbered: str | None = None
    details: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: Logs of industrial protocols and their canonical tag.
PATHS = {
    "modbus": "modbus", "modbus_detailed": "modbus", "modbus_mask_write_register": "modbus", "modbus_read_write_multiple_registers": "modbus",
    "dnp3": "dnp3", "dnp3_control": "dnp3", "dnp3_objects": "dnp3",
    "s7comm": "s7comm", "s7comm_plus": "s7comm", "s7comm_read_szl": "s7comm", "s7comm_upload_download": "s7comm",
    "cip": "cip", "cip_io": "cip", "enip": "enip", "bacnet": "bacnet", "bacnet_property": "bacnet",
    "iec104": "iec104", "iec104_apci": "iec104", "iec104_asdu": "iec104", "opcua": "opcua", "opcua_binary": "opcua",
    "profinet": "profinet", "profinet_dce_rpc": "profinet",
}

#: Modbus function codes, and the names of functions, with their action and operation.
MODBUS_CODES = {
    "1": ("read-coils", "read"), "2": ("read-coils", "read"), "3": ("read-registers", "read"), "4": ("read-registers", "read"),
    "5": ("write-coils", "write"), "6": ("write-registers", "write"), "7": ("read-status", "read"), "8": ("diagnostic", "control"),
    "11": ("read-status", "read"), "12": ("read-status", "read"), "15": ("write-coils", "write"), "16": ("write-registers", "write"),
    "17": ("read-status", "read"), "20": ("read-file", "read"), "21": ("write-file", "write"), "22": ("write-registers", "write"),
    "23": ("write-registers", "write"), "24": ("read-fifo", "read"), "43": ("encapsulated", "other"),
}
DNP3_NAMES = {
    "read": ("read", "read"), "write": ("write", "write"), "stop_appl": ("stop-application", "control"),
    "enable_unsolicited": ("enable-unsolicited", "control"),
}
PROTOCOLS = {
    "modbus": Protocol(
        ("func", "function_code", "function"), MODBUS_CODES,
        (("diagnostic", "diagnostic", "control"), ("write.*coil|coil.*write", "write-coils", "write"), ("write", "write-registers", "write"),
         ("read.*coil|coil.*read", "read-coils", "read"), ("read", "read-registers", "read")),
        "modbus-", "modbus-request", "_", "modbus-request",
        {"unit_id": ("unit_id", "uid_modbus"), "address": ("address", "start_address", "reference_number"), "quantity": ("quantity", "word_count", "bit_count")},
    ),
    "dnp3": Protocol(
        ("fc_request", "function_code", "func", "fc"), DNP3_NAMES,
        (("cold.*restart|restart.*cold", "cold-restart", "control"), ("warm.*restart|restart.*warm", "warm-restart", "control"),
         ("disable.*unsolicited|unsolicited.*disable", "disable-unsolicited", "control"), ("operate|select", "operate", "write"),
         ("write", "write", "write"), ("read", "read", "read")),
        "dnp3-", "dnp3-request", "_", None, {"iin": ("iin", "iin_flags")},
    ),
    "s7comm": Protocol(
        ("function_name", "function", "func"), {},
        (("download", "program-download", "write"), ("upload", "program-upload", "read"), ("write", "write-var", "write"),
         ("read.*szl|szl.*read", "read-szl", "read"), ("read", "read-var", "read"), ("stop", "plc-stop", "control"),
         ("plc[ _]control|start", "plc-control", "control"), ("setup[ _]communication", "setup", "other")),
        "s7-", "s7-request", " _", None, {"rosctr": ("rosctr", "rosctr_name")},
    ),
    "cip": Protocol(
        ("cip_service", "service", "cip_service_name"), {},
        (("set[ _]attribute", "write-attribute", "write"), ("get[ _]attribute", "read-attribute", "read"),
         ("forward[ _]open", "forward-open", "control"), ("forward[ _]close", "forward-close", "control"),
         ("write", "write-attribute", "write"), ("read", "read-attribute", "read")),
        "cip-", "cip-request", " _", None, {"cip_service": ("cip_service", "service")},
    ),
    "bacnet": Protocol(
        ("bacnet_service", "service", "pdu_service"), {},
        (("write", "write-property", "write"), ("read", "read-property", "read"),
         ("reinitialize|devicecommunicationcontrol", "device-control", "control")),
        "bacnet-", "bacnet-request", "", None, {"bacnet_service": ("bacnet_service", "service")},
    ),
}
SAME = {"enip": "cip"}


def _of(table: Protocol, name: Column) -> Column:
    """(action, operation) of a lower-cased function name, empty where there is none."""

    def pair(action, operation: str) -> Column:
        return F.struct((F.lit(action) if isinstance(action, str) else action).alias("action"), F.lit(operation).alias("operation"))

    spelled = F.concat(F.lit(table.prefix), F.translate(name, table.dashed, "-" * len(table.dashed)) if table.dashed else name)
    if not table.fields:
        return pair(table.otherwise, "other")
    cases = [(name == "", pair(table.otherwise, "other"))] + [(name == k, pair(*v)) for k, v in table.exact.items()]
    if table.numbered:
        cases.append((name.rlike("^[0-9]+$"), pair(table.numbered, "other")))
    cases += [(name.rlike(pattern), pair(action, operation)) for pattern, action, operation in table.patterns]
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out.otherwise(pair(spelled, "other"))


def enriched(rows: DataFrame, path: Column, g: Get) -> tuple[DataFrame, Column, Column]:
    """Rows with the columns that the others stand on, the action of an industrial row, null for other logs, and what is
    kept of it: the protocol, the operation, whether it writes, and the protocol's details."""
    rows = rows.withColumn("_protocol", lookup(PATHS, path))
    protocol = F.col("_protocol")
    found = _of(Protocol(), F.lit(""))
    details: dict[str, Column] = {}
    for name, table in PROTOCOLS.items():
        here = protocol.isin(name, *[k for k, v in SAME.items() if v == name])
        each = bind(F.lower(F.btrim(F.coalesce(g(*table.fields), F.lit("")))), partial(_of, table))
        found = F.when(here, each).otherwise(found)
        for key, fields in table.details.items():
            details[key] = F.when(here, g(*fields)).otherwise(details.get(key))
    rows = rows.withColumn("_function", F.when(protocol.isNotNull(), found))
    found = F.col("_function")
    writes = F.when(found["operation"] == "write", "true").otherwise("false")
    kept = F.struct(protocol.alias("protocol"), found["operation"].alias("operation"), writes.alias("is_write"), *[v.alias(k) for k, v in details.items()])
    rows = rows.withColumn("_ot", F.when(protocol.isNotNull(), kept))
    return rows, found["action"], F.col("_ot")
