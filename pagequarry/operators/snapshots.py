"""Merge of two record snapshots: pull with column precedence, push as a plan table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.sql import lit, override, sparse_map
from pagequarry.sources.records import ID_KEY, NO_DESCRIPTION

# marks a key made up from the row number
NO_KEY = "\u0001"


def latest(remote: DataFrame) -> DataFrame:
    """The last of the remote records with one number, at the place of the first of them."""
    row = F.struct(*[c for c in remote.columns if c not in ("number", "pos")])
    return remote.groupBy("number").agg(F.max_by(row, "pos").alias("r"), F.min("pos").alias("pos")).select("number", "pos", "r.*")


def pull(local: DataFrame, remote: DataFrame, side: DataFrame) -> DataFrame:
    """``id, fields, change, status_changed`` of the merged records.

    ``remote`` is ``remote_records``, ``side`` is ``side_fields``.  For a known
    id the title and description come from the remote record and the status when
    it differs; then the side table, then the embedded block win over all.
    Records without an id stay as they are.
    """
    # of records with one id the last counts, on both sides
    named = local.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("fields", "pos").alias("local"))
    unnamed = local.filter(F.col("id").isNull()).select(
        "id", "fields", F.lit("kept").alias("change"), F.lit(False).alias("status_changed")
    )
    incoming = latest(remote).select(
        F.col("number").cast("string").alias("id"),
        F.coalesce("title", F.concat(F.lit("Issue #"), F.col("number"))).alias("title"),
        F.coalesce(F.nullif(F.col("body"), F.lit("")), F.lit(NO_DESCRIPTION)).alias("description"),
        "state",
        "embedded",
    ).join(side, "id", "left")
    both = named.join(incoming, "id", "full")

    known, arrived = "local is not null", "title is not null"
    status_changed = "coalesce(local['status'], 'open') <> state"
    from_remote = sparse_map(
        {
            ID_KEY: f"if({known}, NULL, id)",
            "title": "title",
            "description": "description",
            "status": f"if({known}, if({status_changed}, state, NULL), state)",
        }
    )
    merged = "coalesce(local, map())"
    for layer in (from_remote, "coalesce(side, map())", "coalesce(embedded, map())"):
        merged = override(merged, layer)
    return both.selectExpr(
        "id",
        f"if({arrived}, {merged}, local) as fields",
        f"case when {known} and {arrived} then 'updated' when {arrived} then 'added' else 'kept' end as change",
        f"coalesce({known} and {arrived} and {status_changed}, false) as status_changed",
    ).unionByName(unnamed)


def pull_summary(pulled: DataFrame) -> DataFrame:
    return pulled.agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if("status_changed").alias("status_changed"),
    )


# a value that a reader of the block would not take as it stands
UNSAFE = r"(?s)^$|^[\s\-?:,\[\]{}#&*!|>'%@`" + '"' + r"]|:\s|:$|\s#|\n|\s$|^(?i:null|true|false|yes|no|on|off|~)$"


def dumped(value: str) -> str:
    """A scalar of the block, in double quotes where it needs them."""
    quoted = value
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        quoted = f"replace({quoted}, {lit(plain)}, {lit(code)})"
    mark = lit('"')
    return f"if({value} rlike {lit(UNSAFE)}, concat({mark}, {quoted}, {mark}), {value})"


# fenced block of a record's other keys, in key order
DUMP = (
    f"concat('```yaml\\n', array_join(transform(array_sort(map_entries(map_filter(fields, "
    f"(k, v) -> k not in ('{ID_KEY}', 'title', 'description')))), "
    f"e -> concat(e.key, ': ', {dumped('e.value')}, '\\n')), ''), '```')"
)


def push_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What to send: ``pos, id, action, number, node_id, title, description, state, labels``.

    A record finds its remote one by id, else by its component, case folded, in
    the embedded block of the first such remote record.  Without a component it
    is skipped; without a match it is created.
    """
    f = F.col("fields")
    remote = latest(remote)
    records = local.select(
        "pos",
        "id",
        f["component"].alias("component"),
        f["status"].alias("status"),
        F.coalesce(
            f["title"], F.concat(F.lit("["), f["component"], F.lit("] "), F.coalesce(f["impact"], F.lit("Issue")))
        ).alias("title"),
        F.coalesce(f["description"], F.expr(DUMP)).alias("description"),
        # a NULL key would send all such rows to one task
        F.coalesce("id", F.concat(F.lit(NO_KEY), F.col("pos"))).alias("id_key"),
    )
    target = F.expr("named_struct('number', number, 'node_id', node_id, 'labels', labels.name)")
    by_id = remote.select(F.col("number").cast("string").alias("id_key"), target.alias("same_id"))
    # exploded from a one-element array, so that the block is read once, not again by the filter
    component = F.explode(F.array(F.lower(F.col("embedded")["component"]))).alias("component_key")
    by_component = (
        remote.select("pos", target.alias("target"), component)
        .filter(F.col("component_key").isNotNull())
        .groupBy("component_key")
        .agg(F.min_by(F.col("target"), F.col("pos")).alias("same_component"))
    )
    keyed = records.join(by_id, "id_key", "left").withColumn(
        "component_key",
        F.when(F.col("same_id").isNull() & F.col("component").isNotNull(), F.lower("component")).otherwise(
            F.concat(F.lit(NO_KEY), F.col("pos"))
        ),
    )
    matched = keyed.join(by_component, "component_key", "left").withColumn(
        "target", F.coalesce("same_id", "same_component")
    )
    skip = F.col("component").isNull()
    update = ~skip & F.col("target").isNotNull()
    return matched.select(
        "pos",
        "id",
        F.when(skip, "skip").when(update, "update").otherwise("create").alias("action"),
        F.when(update, F.col("target.number")).alias("number"),
        F.when(update, F.col("target.node_id")).alias("node_id"),
        F.when(~skip, F.col("title")).alias("title"),
        F.when(~skip, F.col("description")).alias("description"),
        F.when(update, F.when(F.lower("status") == "done", "closed").otherwise("open")).alias("state"),
        F.when(update, F.col("target.labels")).alias("labels"),
    )


def push_summary(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if(F.col("action") == "create").alias("created"),
        F.count_if(F.col("action") == "update").alias("updated"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
    )
