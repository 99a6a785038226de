"""The pipe language: grammar, scope errors, null order, time literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave.errors import QueryError
from logweave.functions.text import glob_to_like, token_array, web_search
from logweave.operators.models import Registry, load_yaml, merged
from logweave.plans import nodes as n
from logweave.plans.parser import parse
from logweave.plans.run import pipe, run

AS_OF = dt.datetime(2024, 5, 2, 12)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, dt.datetime(2024, 5, 1, 10), "okta", "system-log", "signin", "high", "deny", "10.0.0.1", "8.8.8.8", 1000, 443, "ann", "web-1", None, 10, "login failed for ann", '{"code": 7, "a.b": "x", "ctx": {"k": 1}}'),
        (2, dt.datetime(2024, 5, 1, 11), "okta", "system-log", "signin", "low", "allow", "10.0.0.2", "8.8.4.4", 1001, 80, "bob", "web-2", "r1", 20, "login ok", '{"code": "8"}'),
        (3, dt.datetime(2024, 5, 2, 11, 59), "cisco", "asa", "605005", None, "allow", None, None, None, None, None, "fw", "r2", None, "100% done a_b", "{}"),
        (4, None, "cisco", "asa", "x", "low", None, "10.0.0.9", None, 5, 22, "ann", None, "r2", 40, "x", '{"code": 7}'),
    ]
    names = "id event_time vendor product log_type severity action src_ip dst_ip src_port dst_port user_name host_name rule_name bytes_total message raw".split()
    types = "id long, event_time timestamp_ntz, vendor string, product string, log_type string, severity string, action string, src_ip string, dst_ip string, src_port int, dst_port int, user_name string, host_name string, rule_name string, bytes_total long, message string, raw string"
    out = spark.createDataFrame(rows, types)
    assert out.columns == names
    return out.withColumn("search_tokens", token_array(F.concat_ws(" ", "vendor", "message", "raw")))


def ids(events, text, **kw):
    return [r.id for r in pipe(events, text, as_of=AS_OF, **kw).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("severity=low", [2, 4]), ("not severity=low", [1]), ("severity=low or action=deny", [1, 2, 4]), ("LOGIN failed", [1]), ("code=7", [1, 4]), ("code=8", [2]),
        ('message="*FAILED*"', [1]), ('message="100% d*"', [3]), ('message="login ??"', [2]), ("rule_name=*", [2, 3, 4]), ("rule_name!=*", [1]),
        ('_time > "-2h"', [3]), ("_time < now", [1, 2, 3]), ('event_time >= "2024-05-01 11:00:00" event_time < "2024-05-02"', [2]), ("src_port in (1000, 5)", [1, 4]),
        ("* | where user_name = 'ann' and bytes_total > 15", [4]), ("* | where message like '100\\\\% %'", [3]), ("* | where isnull(action)", [4]), ("* | where -bytes_total < -15", [2, 4]),
        ("* | sort -bytes_total", [4, 2, 1, 3]), ("* | sort bytes_total", [1, 2, 4, 3]), ("* | sort -rule_name, id", [1, 3, 4, 2]), ("* | sort user_name, -id", [4, 1, 2, 3]),
        ("* | sort -id | dedup user_name | sort id", [2, 3, 4]), ("* | sort -id | head 2", [4, 3]),
    ],
)
def test_filters_and_orders(events, text, want):
    got = ids(events, text)
    assert got == want if "sort" in text else sorted(got) == want


def test_words_in_parentheses_are_fields(events):
    assert ids(events, "(user_name=message or rule_name='r1')") == [2]


def test_substr_counts_places_before_the_first(events):
    row = pipe(events, "id=1 | eval a=substr(message, 0, 3) | eval b=substr(message, -1, 4) | eval c=substr(message, 7) | fields a, b, c").first()
    assert tuple(row) == ("lo", "lo", "failed for ann")


def test_values_keep_one_null_and_lists_all(events):
    row = pipe(events, "* | stats values(severity) as v, list(severity) as l, dc(severity) as d, count(severity)").first()
    assert sorted(row.v, key=str) == ["high", "low", None] or sorted(map(str, row.v)) == ["None", "high", "low"]
    assert len(row.l) == 4 and row.d == 2 and row.count_severity == 3


def test_null_times_keep_a_bucket(events):
    rows = {r._time: r["count"] for r in pipe(events, "* | timechart span=1d count").collect()}
    assert rows == {dt.datetime(2024, 5, 1): 2, dt.datetime(2024, 5, 2): 1, None: 1}


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("a=", "value"), ("| nope", "unknown command"), ("* | head", "whole number"), ("* | head 2.5", "whole number"), ("x > -5", "value"), ("* | stats sum", "needs a field"),
        ("* | stats count by user_name | where id = 1", "unknown field"), ("* | stats count | fields raw", "unknown field"), ("* | eval raw = 1", "reserved"),
        ("* | rename user_name as id", "two columns"), ("* | sort id | fields user_name", "sorted by"), ("* | bin span=1h message", "works on times"), ("* | eval x = nope(1)", "unknown function"),
        ("* | eval x = round(1, 2, 3)", "arguments"), ("* | timechart span=0h count", "span"), ("search a | datamodel web", "first command"), ("from datamodel:nope", "unknown data model"),
        ("from datamodel:dns user_name=x", "not a field of the model"), ("* | stats count | search word", "text of events"), ("'open", "unexpected character"), ("* | where " + "(" * 90 + "1" + ")" * 90, "deeply"),
    ],
)
def test_errors_name_what_is_wrong(events, text, message):
    rows = Registry.load().tag(events)
    with pytest.raises(QueryError, match=message):
        pipe(rows, text, models=Registry.load())


def test_run_reports_failures_and_truncation(events):
    out = run(events, "* | fields id", limit=2)
    assert out.truncated and out.count == 2 and out.fields == ["id"]
    with pytest.raises(QueryError):
        run(events, "* | eval x = message + 1")


def test_spans_and_defaults():
    q = parse("* | timechart span='15 m' count, sum(x) as y by z | top f by a, b")
    assert q.stages[1] == n.Timechart(q.stages[1].pos, n.Span(q.stages[1].span.pos, 900), q.stages[1].aggregates, "z")
    assert [a.label for a in q.stages[1].aggregates] == ["count", "y"] and q.stages[2].count == 10


def test_months_are_pruned(spark, events, tmp_path):
    path = str(tmp_path / "store")
    events.where("event_time is not null").withColumn("event_month", F.date_format("event_time", "yyyy-MM")).write.partitionBy("event_month").parquet(path)
    out = pipe(spark.read.parquet(path), 'event_time >= "2024-05-02" | stats count', limit=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and out.first()["count"] == 1


def test_web_search_and_globs(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "delta a@b.c")], "id int, t string").withColumn("tok", token_array(F.col("t")))
    find = lambda q: [r.id for r in rows.where(web_search(F.col("tok"), q)).collect()]
    assert find("beta -alpha") == [2] and find('alpha or "delta"') == [1, 3] and find("a@b.c") == [3]
    assert glob_to_like("a_%\\*?") == "a\\_\\%\\\\%_"


def test_models_validate_and_merge():
    base = Registry.load()
    assert base.names()[0] == "Authentication" and len(base.models) == 11 and base.fingerprint() == Registry.load().fingerprint()
    with pytest.raises(Exception, match="twice"):
        load_yaml("a: 1\na: 2")
    for bad in ("X: {tag: x, members: [{nope: [1]}], fields: {}}", "X: {tag: x, members: [{vendor: [true]}], fields: {}}", "X: {tag: x, members: [], fields: {a: nope}}"):
        with pytest.raises(Exception, match="no column|neither"):
            Registry.load(bad)
    extra = Registry.load("Web: {tag: web, members: [{log_type: [cdn]}], fields: {edge: host_name}}").models
    assert len(merged(base, extra).find("web").clauses) == 2
    with pytest.raises(Exception, match="exist"):
        merged(base, Registry.load("Web: {tag: web, members: [], fields: {src: src_ip}}").models)


def test_tags_views_and_rederivation(spark, events):
    registry = Registry.load()
    tagged = {r.id: r.cim_models for r in registry.tag(events).collect()}
    assert tagged == {1: ["authentication"], 2: ["authentication"], 3: ["authentication", "network"], 4: ["network"]}
    old = registry.tag(events).withColumn("cim_models", F.when(F.col("id") != 4, F.col("cim_models")))
    assert [r.id for r in registry.rederive(old).collect()] == [4]
    registry.create_views(registry.tag(events))
    assert spark.table("model_network").columns[:4] == ["id", "event_time", "action", "src"]


def test_cells_of_huge_groups_are_cut_before_they_are_collected(spark):
    """Ten million values of one group: a task holds a cell's worth of each salt."""
    from logweave.plans.lower import CELL_CAP

    rows = spark.range(10_000_000).selectExpr("id", "timestamp'2024-01-01 00:00:00' as event_time", "cast(id % 3000000 as string) as user_name", "'h' as host_name", "'{}' as raw", "array('x') as search_tokens")
    out = pipe(rows, "* | stats values(user_name) as v, list(user_name) as l, count as n by host_name")
    row = out.first()
    assert (row.host_name, row.n, len(row.v), len(row.l)) == ("h", 10_000_000, CELL_CAP, CELL_CAP) and row.v == sorted(row.v) and row.v[0] == "0"
