"""Record snapshots kept as JSON lines (``pos, value``): local, remote and side table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.sql import each, keep, last, let, lit, lits, sparse_map, struct

# Fixed values.
ID_KEY = "github_issue"
NO_DESCRIPTION = "[no description]"
PRIORITIES = ["P0", "P1", "P2"]
SIZES = ["XS", "S", "M", "L", "XL"]
SIDE_FIELDS = ["priority", "sprint", "size"]

REMOTE_SCHEMA = (
    "number long, title string, state string, body string, node_id string, "
    "labels array<struct<name: string>>, pull_request map<string, string>"
)
PROJECT_SCHEMA = (
    "content struct<__typename: string, number: long, title: string, body: string, state: string>, "
    "fieldValues struct<nodes: array<struct<__typename: string, name: string, title: string, field: struct<name: string>>>>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a file or folder. ``pos`` sorts by file, block of the file, and line, however files are split."""
    place = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    parts = [F.lpad(p.cast("string"), 20, "0") for p in place]
    return spark.read.text(path).select(F.concat_ws("|", F.col("_metadata.file_path"), *parts).alias("pos"), "value")


def _decode(lines: DataFrame, schema: str) -> DataFrame:
    """``pos`` and the decoded columns.  A generator rather than a projection, so
    that each line is decoded once however many of its fields are used."""
    return lines.select("pos", F.inline(F.array(F.from_json("value", schema, {"mode": "PERMISSIVE"}))))


def local_records(lines: DataFrame) -> DataFrame:
    """``pos, id, fields``: every key of a record in one map; unreadable lines are left out."""
    fields = F.map_filter(F.from_json("value", "map<string, string>"), lambda k, v: v.isNotNull())
    decoded = lines.select("pos", F.explode(F.array(fields)).alias("fields"))
    return decoded.filter(F.col("fields").isNotNull()).select("pos", F.col("fields")[ID_KEY].alias("id"), "fields")


def remote_records(lines: DataFrame) -> DataFrame:
    """Remote records without the pull requests, with the keys of their embedded block."""
    return _remote(lines).filter(F.col("pull_request").isNull()).drop("pull_request")


def skipped_pull_requests(lines: DataFrame) -> DataFrame:
    return _remote(lines).filter(F.col("pull_request").isNotNull()).agg(F.count("*").alias("skipped"))


def _remote(lines: DataFrame) -> DataFrame:
    parsed = _decode(lines, REMOTE_SCHEMA)
    return parsed.filter(F.col("number").isNotNull()).withColumn("embedded", F.expr(embedded_block("body")))


# a line at the left edge of a block: a key, and perhaps a value
TOP_LINE = r"^[A-Za-z_][\w -]*:(\s.*)?$"
NESTED_LINE = r"^(\s+\S.*|-(\s.*)?)$"
DOUBLE_QUOTED = r'^"((?:[^"\\]|\\.)*+)"\s*(#.*)?$'
SINGLE_QUOTED = r"^'((?:[^']|'{2})*+)'\s*(#.*)?$"
NO_VALUE = r"^(|#.*|~|null|Null|NULL|[|>][+-]?)$"
COMMENT = r"\s+#.*$"


def block_value(text: str) -> str:
    """The scalar of a line: quotes undone, a comment cut off; NULL for none, null, or a value on the lines below."""
    double = f"regexp_extract({text}, {lit(DOUBLE_QUOTED)}, 1)"
    for code, plain in (("\\\\", "\x01"), ("\\n", "\n"), ('\\"', '"'), ("\x01", "\\")):
        double = f"replace({double}, {lit(code)}, {lit(plain)})"
    single = f"replace(regexp_extract({text}, {lit(SINGLE_QUOTED)}, 1), {lit(chr(39) * 2)}, {lit(chr(39))})"
    bare = let(
        f"regexp_replace({text}, {lit(COMMENT)}, '')", lambda v: f"if({v} rlike {lit(NO_VALUE)}, NULL, {v})"
    )
    return (
        f"case when {text} rlike {lit(DOUBLE_QUOTED)} then {double} "
        f"when {text} rlike {lit(SINGLE_QUOTED)} then {single} else {bare} end"
    )


def embedded_block(body: str) -> str:
    """Map of the first fenced ``yaml`` block: its ``key: value`` lines at the left edge, values as strings.

    Nested maps and lists below a key are passed over; NULL when the block is not a map.
    """
    block = rf"regexp_extract({body}, r'(?s)```yaml\n(.*?)\n```', 1)"
    lines = keep(rf"split({block}, '\n')", lambda x: rf"not {x} rlike r'^\s*(#.*)?$'")

    def pair(x: str) -> str:
        raw = rf"regexp_extract({x}, r':\s+(.*?)\s*$', 1)"
        return struct(k=rf"regexp_extract({x}, r'^([A-Za-z_][\w -]*?)\s*:', 1)", v=let(raw, block_value))

    def as_map(pairs: str) -> str:
        def values(keys: str) -> str:
            chosen = each(keys, lambda k: f"{last(keep(pairs, lambda p: f'{p}.k = {k}'))}.v")
            return f"map_filter(map_from_arrays({keys}, {chosen}), (k, v) -> v is not null)"

        return let(f"array_distinct({pairs}.k)", values)

    def read(x: str) -> str:
        fits = f"forall({x}, y -> y rlike {lit(TOP_LINE)} or y rlike {lit(NESTED_LINE)})"
        tops = keep(x, lambda y: f"{y} rlike {lit(TOP_LINE)}")
        return f"if(size({x}) > 0 and get({x}, 0) rlike {lit(TOP_LINE)} and {fits}, {let(each(tops, pair), as_map)}, NULL)"

    return let(lines, read)


def project_records(lines: DataFrame) -> DataFrame:
    """Side-table entries: ``id, title, description, status, priority, sprint, size``; a later entry of an id wins."""
    parsed = _decode(lines, PROJECT_SCHEMA).select("pos", "content", F.col("fieldValues.nodes").alias("nodes"))
    issues = parsed.filter(F.col("content.__typename") == "Issue")

    def latest(test: str, value: str) -> Column:
        return F.expr(f"{last(f'filter(nodes, n -> coalesce({test}, false))')}.{value}")

    def chosen(names: list[str]) -> str:
        return f"n.__typename = 'ProjectV2ItemFieldSingleSelectValue' and n.name in ({lits(names)})"

    sprint = "n.__typename = 'ProjectV2ItemFieldIterationValue' and lower(n.field.name) = 'sprint' and n.title <> ''"
    entries = issues.select(
        F.col("content.number").cast("string").alias("id"),
        "pos",
        F.struct(
            F.coalesce("content.title", F.lit("")).alias("title"),
            F.coalesce(F.nullif(F.col("content.body"), F.lit("")), F.lit(NO_DESCRIPTION)).alias("description"),
            F.coalesce("content.state", F.lit("open")).alias("status"),
            latest(chosen(PRIORITIES), "name").alias("priority"),
            latest(sprint, "title").alias("sprint"),
            latest(chosen(SIZES), "name").alias("size"),
        ).alias("entry"),
    )
    return entries.groupBy("id").agg(F.max_by("entry", "pos").alias("entry")).select("id", "entry.*")


def side_fields(entry: DataFrame) -> DataFrame:
    """``id, side``: the side-table fields that are set, as a map."""
    return entry.select("id", F.expr(sparse_map({f: f for f in SIDE_FIELDS})).alias("side"))
