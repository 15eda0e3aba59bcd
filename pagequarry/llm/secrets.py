"""Secret scans over an incremental ledger of blobs, in built-in functions only.

Every version of every text is addressed by the SHA-256 of its content. A ledger keeps, for each blob, which
versions of which rules have been run over it and what they matched. A run looks up the pairs of blob and rule
version that the ledger does not hold, scans only those, appends them in one write, and joins the findings of
all blobs back to every path that holds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagequarry.llm.common import stored
from pagequarry.session import new_dir


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax, without look-around) and an SQL test of a match ``x``. A changed rule takes a new version."""

    kind: str
    version: int
    pattern: str
    keeps: str = "true"

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: The three base kinds in their order of listing. A run of hexadecimal digits is maximal, so its least size can stand
#: in the pattern; the other two test each match, as a short match uses up its characters.
BASE = [
    Rule("assign", 1, ASSIGN, f"length(regexp_extract(x, {quoted(ASSIGN)}, 2)) >= 6"),
    Rule("access", 1, "AKIA[A-Z0-9]+", "length(x) >= 20"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
]
#: Further kinds: private keys, service tokens, logins inside URLs.
MORE = [
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("login", 1, r"://[^/:@ \t\n\r]+:[^/:@ \t\n\r]+@"),
]
RULES = [*BASE, *MORE]

LEDGER = "blob binary, rules array<string>, pieces array<struct<rule: string, at: int, gap: int, size: int, kept: boolean>>"


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the SHA-256 of the text; a NULL text is the empty blob."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def pieces(rule: Rule) -> str:
    """SQL: the matches of a rule in ``text``, in order, each with the length of the text before it since the last.

    Splitting at the pattern gives what lies between the matches, so no positions have to be searched.
    """
    pattern = quoted(rule.pattern)
    return (
        f"if(array_contains(todo, {quoted(rule.name)}) and text rlike {pattern}, "
        f"transform(zip_with(regexp_extract_all(text, {pattern}, 0), split(text, {pattern}, -1), (x, g) -> "
        f"struct(length(g) as gap, coalesce(length(x), 0) as size, x is not null and {rule.keeps} as kept)), (p, i) -> "
        f"struct({quoted(rule.name)} as rule, i as at, p.gap as gap, p.size as size, p.kept as kept)), "
        "cast(array() as array<struct<rule: string, at: int, gap: int, size: int, kept: boolean>>))"
    )


class Ledger:
    """Scans kept under ``path``, a folder that all executors reach; made empty if it is not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, versions: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
        """``blob, text, todo``: each blob once, with the names of the rules that have not been run over it."""
        wanted = F.array(*[F.lit(r.name) for r in rules])
        once = addressed(versions.select(F.coalesce(F.col(text), F.lit("")).alias("text"))).groupBy("blob").agg(F.first("text").alias("text"))
        seen = self.read().select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules]))
        seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        left = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        return once.join(seen, "blob", "left").select("blob", "text", left.alias("todo")).where("size(todo) > 0")

    def update(self, versions: DataFrame, rules: list[Rule], text: str = "text") -> None:
        """Runs every rule over the blobs that its version has not seen, and appends what it did."""
        if not rules:
            return
        parts = ", ".join(map(pieces, rules))
        self.unseen(versions, rules, text).select(
            "blob", F.col("todo").alias("rules"), F.expr(f"concat({parts})").alias("pieces")
        ).write.mode("append").parquet(self.path)

    def findings(self, rules: list[Rule]) -> DataFrame:
        """``blob, kind, start, end`` of every kept match of these rules: code points, the end not included."""
        names = [r.name for r in rules]
        every = self.read().where("size(pieces) > 0").select("blob", F.inline("pieces")).where(F.col("rule").isin(names)).distinct()
        before = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = every.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(before)).where("kept")
        return placed.select("blob", F.substring_index("rule", "@", 1).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def scan(versions: DataFrame, ledger: Ledger, rules: list[Rule] = RULES, *, text: str = "text") -> DataFrame:
    """``versions`` with ``spans``, the findings of its text: ``array<struct<start, kind, end>>`` by start and kind.

    Kinds stand in the order of ``rules``. A NULL or empty text has none; repeated rows and equal texts are
    scanned once and get the same spans; an empty table gives no rows. Matches of one kind do not overlap, those
    of different kinds may. One text's findings must fit in one row. ``versions`` may hold columns of any name
    but ``spans`` and may repeat paths: every row is a version.
    """
    ledger.update(versions.select(F.col(text).alias("text")), rules)
    order = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", F.array_position(order, F.col("kind")).alias("place"), "kind", "end")
    by_blob = ledger.findings(rules).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("found"))
    # stored, so that both sides of the join come from a scan and rows of a frequent blob can be split
    found = stored(by_blob.select(F.col("blob").alias("__blob"), F.expr("transform(found, s -> struct(s.start, s.kind, s.end))").alias("spans")), "findings")
    rows = versions.select(F.struct("*").alias("__row"), F.col(text).alias("text"))
    joined = addressed(rows).join(found, F.col("blob") == F.col("__blob"), "left")
    empty = F.array().cast("array<struct<start: bigint, kind: string, end: bigint>>")
    return joined.select("__row.*", F.coalesce("spans", empty).alias("spans"))


def joined(spans: str) -> str:
    """SQL: ``kind:start:end`` of each span, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def document_secrets(docs: DataFrame, ledger: Ledger | None = None, more: list[Rule] = MORE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``docs``.

    Without a ledger of its own the run starts from an empty one. Other columns are ignored.
    """
    ledger = ledger or Ledger(docs.sparkSession, new_dir(docs.sparkSession, "ledger"))
    kinds = [r.kind for r in BASE]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the text is hashed and left behind, so that what is joined and written is small
    base = f"filter(spans, s -> s.kind in ({', '.join(map(quoted, kinds))}))"
    count = "cast(size(filter(spans, s -> s.kind = '{}')) as long)"
    return scan(slim, ledger, [*BASE, *more]).select(
        "doc_id",
        *[F.expr(count.format(kind)).alias(f"n_{kind}") for kind in kinds],
        F.sha2(F.expr(joined(base)), 256).alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
    )
