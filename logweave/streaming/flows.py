"""Binary flow exports as a stream: templates are state, all else is that of the batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logweave.scratch import scope, written
from logweave.sources import flows
from logweave.sources.json_formats import netflow

#: How long a template is kept that is not sent again.
TEMPLATE_MS = 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a set's header says rides along as JSON text: numbers of 64 bits with nulls would be rounded on their way.
_HEAD = "version int, sequence long, exported long, boot long, engine array<int>"
_OUT = "exporter string, domain long, n long, k int, kind string, head string, body binary, text string"
_ROW = f"{_OUT}, template_id int, j int"


class Templates(StatefulProcessor):
    """Of one template id of an exporter and domain: the last definition, as JSON text, for the data sets behind it.
    Data sets without one come out with a null."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("layout", "text string", TEMPLATE_MS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = pd.concat([r.astype(object) for r in rows]).sort_values(["n", "k", "j"], kind="stable").reset_index(drop=True)
        given = found["text"].where(found["kind"] != "data")
        known = self.last.get()[0] if self.last.exists() else None
        texts = given.replace({None: pd.NA}).ffill()
        found["text"] = texts.where(texts.notna(), known)
        # each definition, the same one too, begins its time anew
        if given.notna().any():
            self.last.update((texts.iloc[-1],))
        out = found[found["kind"].isin(["data", "first"])].astype(object)
        if len(out):
            yield out.where(out.notna(), None)[[c.split()[0] for c in _OUT.split(", ")]]

    def close(self) -> None:
        pass


def _rows(found: DataFrame) -> DataFrame:
    """Sets, and in place of sets of templates their definitions."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r["kind"] in ("template", "options"):
                    known = flows.definitions(r["kind"], json.loads(r["head"])["version"], bytes(r["body"]))
                    out += [{**r, "template_id": t, "j": j, "text": json.dumps(what), "body": None} for j, (t, what) in enumerate(known) if what]
                elif r["kind"] != "none":
                    out.append({**r, "template_id": r["set_id"], "j": -1, "text": _FIRST if r["kind"] == "first" else None})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")])

    head = F.to_json(F.struct(*[c.split()[0] for c in _HEAD.split(", ")])).alias("head")
    return found.select("exporter", "domain", "n", "k", "kind", "set_id", head, "body").mapInPandas(each, _ROW)


_FIRST = json.dumps(flows.layout([(element, length, 0) for element, length in flows.FIRST_FORMAT], False))


def with_templates(packets: DataFrame) -> DataFrame:
    """The data sets of a stream of packets, each with the layout (JSON text) of its template, or null."""
    keyed = _rows(flows.sets(packets)).groupBy("exporter", "domain", "template_id")
    return keyed.transformWithStateInPandas(Templates(), _OUT, "append", "ProcessingTime")


def flow_stream(packets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, interval: str | None = None) -> StreamingQuery:
    """Starts a stream of recorded packets (exporter, n, data); sink gets each batch's flow events and its number. Without
    an interval it takes what is there and ends."""
    def each(batch: DataFrame, number: int) -> None:
        with scope():
            take(batch, number)

    def take(batch: DataFrame, number: int) -> None:
        met = batch.withColumns({"layout": F.from_json("text", flows._LAYOUT), "h": F.from_json("head", _HEAD)})
        # stored once: it is read for records of fixed and of variable length, and computing it again would run the state again
        met = written(met.select("exporter", "domain", "n", "k", "kind", "h.*", "body", "layout"), "flow-sets")
        sink(netflow(flows.flows(met).select("value")), number)

    # batches without data would follow each other for ever, as states with a time limit always ask for one more
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    conf = packets.sparkSession.conf
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        writer = with_templates(packets).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
