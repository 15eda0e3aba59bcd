"""Pull and push of record snapshots."""

import json

from pyspark.sql import functions as F

from pagequarry.operators.snapshots import pull, pull_summary, push_plan, push_summary
from pagequarry.sources.records import (
    embedded_block, local_records, project_records, read_lines, remote_records, side_fields, skipped_pull_requests,
)
from pagequarry.sources.sinks import write_records

BLOCK = "Seen twice.\n```yaml\ncomponent: {}\nowner: dock team\nimpact: slow start\nstatus: {}\n```\nThanks"


def lines(spark, records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "pos long, value string")


def no_side(spark):
    return side_fields(project_records(lines(spark, [])))


def pulled(spark, local, remote, side=None):
    df = pull(
        local_records(lines(spark, local)),
        remote_records(lines(spark, remote)),
        side_fields(project_records(lines(spark, side or []))),
    )
    return {r["fields"].get("github_issue") or r["fields"]["component"]: r for r in df.collect()}


def test_pull_adds_and_keeps(spark):
    rows = pulled(
        spark,
        [{"component": "Ramp", "status": "todo"}],
        [
            {"number": 4711, "state": "open", "body": BLOCK.format("Buoy", "todo")},
            {"number": 4712, "state": "open", "body": "no block"},
            {"number": 4720, "state": "open", "body": "```yaml\nowner: yard\n```"},
            {"number": 4730, "state": "closed", "body": "```yaml\n- component: List\n```", "title": "L"},
            {"number": 4741, "state": "open", "body": "```yaml\n<<< : not\n```"},
            {"number": 4742, "state": "open", "title": "pr", "pull_request": {"url": "x"}},
            {"number": 4750, "state": "open", "body": ""},
        ],
    )
    assert rows["Ramp"]["change"] == "kept" and rows["Ramp"]["fields"] == {"component": "Ramp", "status": "todo"}
    assert rows["4711"]["fields"]["component"] == "Buoy" and rows["4711"]["fields"]["status"] == "todo"
    assert rows["4712"]["fields"] == {"github_issue": "4712", "title": "Issue #4712", "description": "no block", "status": "open"}
    assert "component" not in rows["4720"]["fields"] and rows["4720"]["fields"]["owner"] == "yard"
    assert "component" not in rows["4730"]["fields"] and rows["4730"]["fields"]["status"] == "closed"
    assert "component" not in rows["4741"]["fields"]
    assert rows["4750"]["fields"]["description"] == "[no description]"
    assert "4742" not in rows and len(rows) == 7


def test_pull_updates_by_precedence(spark):
    rows = pulled(
        spark,
        [
            {"github_issue": 1, "title": "old", "status": "done", "priority": "P9", "note": "mine"},
            {"github_issue": 2, "component": "C"},
            {"github_issue": 3, "status": "todo", "size": "S"},
        ],
        [
            {"number": 1, "state": "open", "title": "new", "body": "text"},
            {"number": 2, "state": "open", "title": "t2", "body": BLOCK.format("D", "done")},
        ],
        [
            {"content": {"__typename": "Issue", "number": 1}, "fieldValues": {"nodes": [
                {"__typename": "ProjectV2ItemFieldSingleSelectValue", "name": "P0"},
                {"__typename": "ProjectV2ItemFieldSingleSelectValue", "name": "P2"},
                {"__typename": "ProjectV2ItemFieldSingleSelectValue", "name": "XL"},
                {"__typename": "ProjectV2ItemFieldIterationValue", "title": "S1", "field": {"name": "Sprint"}},
                {"__typename": "ProjectV2ItemFieldIterationValue", "title": "no", "field": {"name": "Quarter"}},
            ]}},
            {"content": {"__typename": "DraftIssue", "number": 2}, "fieldValues": {"nodes": []}},
            {"content": None},
        ],
    )
    assert rows["1"]["fields"] == {
        "github_issue": "1", "title": "new", "description": "text", "status": "open",
        "priority": "P2", "size": "XL", "sprint": "S1", "note": "mine",
    }
    assert rows["1"]["status_changed"] and rows["1"]["change"] == "updated"
    # no local status counts as open, so none is gained from the remote; the block sets it
    assert rows["2"]["fields"]["status"] == "done" and not rows["2"]["status_changed"]
    assert rows["2"]["fields"]["component"] == "D"
    assert rows["3"]["change"] == "kept" and rows["3"]["fields"] == {"github_issue": "3", "status": "todo", "size": "S"}


def test_pull_summary(spark, tmp_path):
    local = local_records(lines(spark, [{"github_issue": 1, "status": "x"}, "not json"]))
    raw = lines(spark, [{"number": 1, "state": "open"}, {"number": 2, "state": "open"}, {"number": 3, "pull_request": {}}])
    merged = pull(local, remote_records(raw), no_side(spark))
    assert pull_summary(merged).first().asDict() == {"added": 1, "updated": 1, "status_changed": 1}
    assert skipped_pull_requests(raw).first()["skipped"] == 1
    target = str(tmp_path / "records")
    write_records(merged, target, dry_run=True)
    assert not (tmp_path / "records").exists()
    write_records(merged, target)
    assert local_records(read_lines(spark, target)).count() == 2


def test_embedded_block(spark):
    cases = {
        "```yaml\na: 1\nb: 'x y'\n\n# note\nc:\n```": {"a": "1", "b": "x y"},
        "```yaml\na: 1\na: 2\n```": {"a": "2"},
        "```yaml\na: A # c\nb: null\nc: ~\nd: '#x'\ne: \"p\\nq \\\"r\\\" \\\\n\"\n```": {"a": "A", "d": "#x", "e": 'p\nq "r" \\n'},
        "```yaml\na: 1\nmore:\n  a: 2\nlist:\n- 3\ntext: |\n  long\nz: it''s\ny: 'it''s'\n```": {"a": "1", "z": "it''s", "y": "it's"},
        "```yaml\n- a: 1\n```": None,
        "```yaml\n  a: 1\n```": None,
        "none": None,
        None: None,
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b string")
    got = [r["m"] for r in df.select("i", F.expr(embedded_block("b")).alias("m")).orderBy("i").collect()]
    assert got == list(cases.values())


def plan(spark, local, remote):
    df = push_plan(local_records(lines(spark, local)), remote_records(lines(spark, remote)))
    return df, df.orderBy("pos").collect()


def test_push(spark):
    local = [
        {"component": "Fresh", "impact": "Rust on the hook", "status": "todo"},
        {"component": "Winch", "size": "M", "status": "Done"},
        {"owner": "nobody"},
        {"github_issue": 99, "component": "Other", "title": "Kept", "description": "as is"},
        {"github_issue": 90210, "component": "MISSING"},
        {"component": "Bare"},
    ]
    remote = [
        {"number": 831, "state": "open", "body": "```yaml\nowner: x\n```"},
        {"number": 829, "state": "open", "body": BLOCK.format("winch", "todo"), "labels": [{"name": "pier"}, {"name": "crane"}]},
        {"number": 815, "state": "open", "body": BLOCK.format("WINCH", "todo")},
        {"number": 99, "state": "open", "body": None},
    ]
    df, rows = plan(spark, local, remote)
    assert [(r["action"], r["number"], r["state"]) for r in rows] == [
        ("create", None, None), ("update", 829, "closed"), ("skip", None, None),
        ("update", 99, "open"), ("create", None, None), ("create", None, None),
    ]
    assert rows[0]["title"] == "[Fresh] Rust on the hook"
    assert rows[0]["description"] == "```yaml\ncomponent: Fresh\nimpact: Rust on the hook\nstatus: todo\n```"
    assert rows[1]["labels"] == ["pier", "crane"]
    assert (rows[3]["title"], rows[3]["description"]) == ("Kept", "as is")
    assert rows[5]["title"] == "[Bare] Issue"
    assert push_summary(df).first().asDict() == {"created": 3, "updated": 2, "skipped": 1}


def test_last_of_one_id_counts(spark):
    local = [{"github_issue": 7, "title": "first"}, {"github_issue": 7, "title": "second", "note": "n"}]
    remote = [
        {"number": 7, "state": "open", "title": "early", "body": BLOCK.format("Hull", "todo"), "node_id": "n1"},
        {"number": 7, "state": "closed", "title": "late", "body": BLOCK.format("Mast", "todo"), "node_id": "n2"},
    ]
    rows = pulled(spark, local, remote)
    assert list(rows) == ["7"] and rows["7"]["fields"]["title"] == "late" and rows["7"]["fields"]["note"] == "n"
    _, sent = plan(spark, [{"github_issue": 7, "component": "Hull"}], remote)
    assert [(r["action"], r["number"], r["node_id"]) for r in sent] == [("update", 7, "n2")]


def test_pos_follows_file_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"github_issue": 1}\n')
    (tmp_path / "b.json").write_text("".join(f'{{"github_issue": {i}}}\n' for i in range(2, 900)))
    rows = local_records(read_lines(spark, str(tmp_path))).orderBy("pos").collect()
    assert [int(r["id"]) for r in rows] == list(range(1, 900))


def test_values_survive_push_and_pull(spark):
    values = ["a: b", "# x", "- y", "it's", 'say "no"', "two\nlines", "null", "back\\slash", " lead", "plain", "ends:", "a #b"]
    _, sent = plan(spark, [{"component": "C", "note": v} for v in values], [])
    back = spark.createDataFrame([(r["pos"], r["description"]) for r in sent], "pos long, d string")
    got = back.select("pos", F.expr(embedded_block("d")).alias("m")).orderBy("pos").collect()
    assert [r["m"]["note"] for r in got] == values
