"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by three patterns: assignments to secret-like names, access keys and long hexadecimal tokens.
The hashes of their values are counted over the corpus, by distinct repositories and owners: an owner is the source
that a document comes from, a repository the document itself, copies of one text counting once (both are arguments). A
value that several owners or many repositories hold is a widely copied example, any other is live-looking. Values
assigned somewhere and live-looking are looked for wherever they stand alone, which adds spans of kind "reuse": a
whole run of value characters, what follows the first "=" of a run, or a piece between "=" with or without the "="
behind it (or all but the last of them), each also less its closing full stops or all its closing punctuation. Every
such text of the least length of an assigned value is compared, by an equi-join with the live-looking values; of
reuses in one another the longest stays.

Long texts are searched in pieces that end before a character that no match can hold.

Defined cases: a null text has no spans; spans are code points, end exclusive; a null repository or owner counts as
one more; repeated rows get one result row each and count once as repositories; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import same_rows, written

#: Kinds in the order of spans that start together, and their patterns.
KINDS = ["assign", "access", "hex", "reuse"]
NAMES = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"{NAMES}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Runs of value characters, and what may be a value in them: (pattern, group).
_ALL, _PART = "[A-Za-z0-9+/_.=-]", "[A-Za-z0-9+/_.-]"
RUN = _ALL + "{%d,}" % LEAST["assign"]
PLAIN = "^[A-Za-z0-9+/_.-]*[A-Za-z0-9]$"
ALONE = [
    *[(rf"(?<!{_ALL}){_ALL}*{last}", 0) for last in (_ALL, "[A-Za-z0-9+/_=-]", "[A-Za-z0-9]")],
    *[(rf"(?<!{_ALL}){_PART}*+=++({_ALL}*{last})", 1) for last in (_ALL, "[A-Za-z0-9+/_=-]", "[A-Za-z0-9]")],
    *[(rf"(?<!{_PART}){_PART}*{last}", 0) for last in (_PART, "[A-Za-z0-9+/_-]", "[A-Za-z0-9]")],
    (rf"(?<!{_PART}){_PART}+=+", 0),
    (rf"(?<!{_PART}){_PART}+=+(?==)", 0),
]
#: A value of at least so many owners or repositories is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 4
#: Pieces of long texts: so many characters, and on to one that is in no match.
PIECE_CHARS = 65_536
PIECE = r"(?s).{1,%d}+[A-Za-z0-9+/_.=:\"'\x20-]*+"


def _spans(
    text: Column, kind: int, pattern: str, group: int, least: int, among: Column | None = None, piece: int = PIECE_CHARS
) -> Column:
    """Matches, leftmost and non-overlapping, as structs (start, kind, end, value hash); short ones are dropped. With
    hashes to look among, others are dropped too, and a span is that of the value, with which the match ends."""

    def within(part: Column, begin: Column) -> Column:
        found = F.arrays_zip(
            F.split(part, pattern, -1).alias("gap"),
            F.regexp_extract_all(part, F.lit(pattern), F.lit(0)).alias("all"),
            F.regexp_extract_all(part, F.lit(pattern), F.lit(group)).alias("value"),
        )
        empty = F.array().cast("array<struct<start:int,kind:int,end:int,vh:bigint>>")

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["all"])
            first = start if among is None else end - F.length(x["value"])
            span = F.struct(
                first.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(x["value"]).alias("vh")
            )
            # only long enough values are appended: the others just move the place
            wanted = F.length(x["value"]) >= least
            if among is not None:
                wanted = wanted & F.array_contains(among, F.xxhash64(x["value"]))
            kept = F.when(wanted, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.when(x["all"].isNull(), acc).otherwise(F.struct(end.alias("at"), kept.alias("out")))

        return F.aggregate(found, F.struct(begin.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    def each(parts: Column) -> Column:
        begin = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, x: n + F.length(x))
        return F.flatten(F.transform(parts, lambda x, i: within(x, begin(i))))

    pieces = F.array(F.regexp_extract_all(text, F.lit(PIECE % piece), F.lit(0)))
    many = F.get(F.transform(pieces, each), 0)
    return F.when(F.octet_length(text) <= piece, within(text, F.lit(0))).otherwise(many)


def _base(t: Column) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int,vh:bigint>>")
    assign = F.when(t.rlike(NAMES + r"[\"']?\x20*[:=]"), _spans(t, 0, ASSIGN, 1, LEAST["assign"])).otherwise(none)
    access = F.when(t.contains("AKIA"), _spans(t, 1, ACCESS, 0, LEAST["access"])).otherwise(none)
    hexes = F.when(t.rlike("[0-9a-f]{%d}" % LEAST["hex"]), _spans(t, 2, HEX, 0, LEAST["hex"])).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def scan(docs: DataFrame, *, doc_id: str, text: str, repository: Column, owner: str) -> DataFrame:
    """Rows (doc_id, h, repo, owner, base): spans of the patterns."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("h"),
        repository.alias("repo"),
        F.col(owner).alias("owner"),
        _base(F.coalesce(F.col(text), F.lit(""))).alias("base"),
    )


def reuses(docs: DataFrame, known: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, h, start, kind, end): the values of known (vh) that stand alone. The texts that hold any are found
    first, so that places are counted in those only."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    runs = F.array_distinct(F.regexp_extract_all("t", F.lit(RUN), F.lit(0)))
    runs = keyed.select("doc_id", "h", F.explode_outer(runs).alias("r")).where("r is not null")
    forms = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("r", F.lit(p), F.lit(g)) for p, g in ALONE])))
    each = runs.select("doc_id", "h", F.explode_outer(F.when(F.col("r").rlike(PLAIN), F.array("r")).otherwise(forms)).alias("v"))
    each = each.where(F.length("v") >= LEAST["assign"]).select("doc_id", "h", F.xxhash64("v").alias("vh"))
    hold = each.join(known, "vh").groupBy("doc_id", "h").agg(F.collect_set("vh").alias("_among"))
    hold = written(hold.withColumnsRenamed({"doc_id": "_d", "h": "_h"}), "secret-reuse")
    met = keyed.join(hold, same_rows([F.col("doc_id"), F.col("h")], [F.col("_d"), F.col("_h")]))
    found = F.concat(*[_spans(F.col("t"), 3, p, g, LEAST["assign"], F.col("_among")) for p, g in ALONE])
    met = met.select("doc_id", "h", _base(F.col("t")).alias("base"), F.array_distinct(found).alias("found"))
    met = met.select("doc_id", "h", "base", "found", F.explode_outer("found").alias("b")).where("b is not null")
    inside = lambda x: (x["start"] <= F.col("b.start")) & (F.col("b.end") <= x["end"])
    met = met.where(~F.exists("base", lambda x: (x["start"] < F.col("b.end")) & (F.col("b.start") < x["end"])))
    met = met.where(~F.exists("found", lambda x: inside(x) & (x["end"] - x["start"] > F.col("b.end") - F.col("b.start"))))
    return met.select("doc_id", "h", "b.start", "b.kind", "b.end")


def ownership(spans: DataFrame) -> DataFrame:
    """Rows (vh, n_docs, n_repos, n_owners, assigned): how widely each value is held. Counted in two steps, so that a
    value that a third of the corpus holds is combined before the shuffle."""
    each = spans.groupBy("vh", "repo", "owner").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") == 0).alias("assigned"))
    repos = each.groupBy("vh", "repo").agg(F.sum("n").alias("n"), F.max("assigned").alias("assigned"))
    owners = each.groupBy("vh", "owner").agg(F.lit(1).alias("one"))
    repos = repos.groupBy("vh").agg(
        F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_repos"), F.max("assigned").alias("assigned")
    )
    return repos.join(owners.groupBy("vh").agg(F.count(F.lit(1)).alias("n_owners")), "vh")


def _join(spans: Column, rating: bool = False) -> Column:
    def one(x: Column) -> Column:
        parts = [F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), x["start"], x["end"]]
        rated = [F.when(x["example"], "example").otherwise("live")] if rating else []
        return F.concat_ws(":", *parts, *rated)

    return F.array_join(F.transform(spans, one), ",")


def secrets(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    repository: str | None = None,
    owner: str = "source",
) -> DataFrame:
    """Per document: base and all spans, each of these with its rating, and how many are live-looking or examples.

    Without a repository column the text itself is the repository, so that copies of one text count once.
    """
    repo = F.col(repository) if repository else F.xxhash64(F.col(text))
    rows = written(scan(docs, doc_id=doc_id, text=text, repository=repo, owner=owner), "secret-scan")
    held = rows.where(F.size("base") > 0).select("doc_id", "h", "repo", "owner", F.explode("base").alias("x"))
    held = held.select("doc_id", "h", "repo", "owner", "x.start", "x.kind", "x.end", "x.vh")
    owners = written(ownership(held), "secret-owners")
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOSITORIES)
    owners = owners.withColumn("example", example)
    rated = held.join(owners.select("vh", "example"), "vh")
    known = owners.where("assigned and not example").select("vh")
    alone = reuses(docs, known, doc_id=doc_id, text=text).withColumn("example", F.lit(False))
    every = rated.select("doc_id", "h", "start", "kind", "end", "example").unionByName(alone)
    span = F.struct("start", "kind", "end", "example")
    per_doc = every.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    keys = [F.col("doc_id"), F.col("h")], [F.col("_d"), F.col("_h")]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean>>")
    out = rows.join(per_doc, same_rows(*keys), "left").select("doc_id", "h", "base", F.coalesce("spans", none).alias("spans"))
    n = lambda example: F.size(F.filter("spans", lambda x: x["example"] == example)).cast("long")
    return out.select("*", n(False).alias("n_live"), n(True).alias("n_example"))


def op5_secrets(docs: DataFrame) -> DataFrame:
    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return secrets(docs).select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_join(F.col("base")), 256).alias("base_sha256"),
        _join(F.col("spans")).alias("spans"),
        _join(F.col("spans"), rating=True).alias("ratings"),
        "n_live",
        "n_example",
    )
