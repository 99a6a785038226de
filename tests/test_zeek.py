"""Header-carrying logs read by splits, and industrial functions."""

import json
import random

from pyspark.sql import functions as F

from logweave.sources import zeek


def sequential(text):
    """Records in the order of the file, by one pass."""
    sep, unset, empty, names, path, out = "\t", "-", "(empty)", [], "conn", []
    for line in text.split("\n"):
        if line.startswith("#separator"):
            spec = line.partition(" ")[2].strip()
            sep = chr(int(spec[2:], 16)) if spec.lower().startswith("\\x") else spec or "\t"
        elif line.startswith("#"):
            key, _, rest = line[1:].partition(sep)
            if key == "fields":
                names = rest.split(sep)
            path = rest.strip() if key == "path" else path
            unset = rest.strip() if key == "unset_field" else unset
            empty = rest.strip() if key == "empty_field" else empty
        elif line and names:
            row = dict(zip(names, line.split(sep)))
            out.append({"_path": path} | {k: v for k, v in row.items() if v not in (unset, empty) and k != "_path"})
    return out


def changing(rng, rows):
    lines = ["no header yet\tx"]
    sep, n = "\t", 3
    for i in range(rows):
        if i == 0 or rng.random() < 0.02:
            sep = rng.choice(["\t", "|", "."])
            if rng.random() < 0.7:
                lines.append(f"#separator \\x{ord(sep):02x}" if rng.random() < 0.8 else f"#separator {sep}")
            else:
                sep = None
        if i == 0 or sep is None or rng.random() < 0.01:
            now = next((chr(int(x[13:], 16)) if "\\x" in x else x[11:] for x in reversed(lines) if x.startswith("#separator")), "\t")
            sep, n = now, rng.randrange(1, 6)
            names = [rng.choice(["a", "b", "ts", "c d", "e"]) for _ in range(n)]
            for key, value in (("path", rng.choice(["conn", "dns"])), ("unset_field", rng.choice(["-", "?"])), ("empty_field", "(empty)"), ("fields", sep.join(names)), ("types", "x")):
                if rng.random() < 0.8 or key == "fields":
                    lines.append(f"#{key}{sep}{value}")
        now = next((chr(int(x[13:], 16)) if "\\x" in x else x[11:] for x in reversed(lines) if x.startswith("#separator")), "\t")
        lines.append(now.join(rng.choice(["-", "?", "(empty)", f"v{i}", "", "é"]) for _ in range(rng.randrange(1, n + 2))))
    return "\n".join(lines) + "\n\n#close\tx\n"


def canonical(records):
    return sorted(json.dumps(r, sort_keys=True) for r in records)


def test_a_file_over_many_splits_equals_one_pass(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    texts = [changing(rng, 3000), changing(rng, 40), "", "#fields\ta\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.log").write_text(text, encoding="utf-8")
    seen = []
    real = zeek.tsv_records
    monkeypatch.setattr(zeek, "tsv_records", lambda lines: seen.append(lines) or real(lines))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        zeek.zeek_tsv_files(spark, str(tmp_path)).count()
        lines = seen[0]
        assert lines.where(F.col("file").endswith("f0.log")).select("start").distinct().count() >= 20
        got = [json.loads(r.raw) for r in real(lines).collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert canonical(got) == canonical([r for t in texts for r in sequential(t)])


def test_whole_files_as_rows(spark):
    rng = random.Random(3)
    texts = [changing(rng, 200) for _ in range(3)]
    rows = zeek.zeek_tsv(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "value string"))
    got = [json.loads(r.raw) for r in rows.collect()]
    for r in got:
        r.pop("ot", None)
    assert canonical(got) == canonical([r for t in texts for r in sequential(t)])


def test_industrial_details_are_kept(spark):
    text = "#fields\tuid_modbus\tfunc\tstart_address\tquantity\n#path\tmodbus_detailed\n3\tREAD_COILS\t40\t2\n-\tDIAGNOSTICS\t-\t-"
    rows = zeek.zeek_tsv(spark.createDataFrame([(text,)], "value string")).select("action", F.get_json_object("raw", "$.ot").alias("ot")).collect()
    assert {r.action: json.loads(r.ot) for r in rows} == {
        "read-coils": {"protocol": "modbus", "operation": "read", "is_write": "false", "unit_id": "3", "address": "40", "quantity": "2"},
        "diagnostic": {"protocol": "modbus", "operation": "control", "is_write": "false"},
    }
