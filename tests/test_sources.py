import json

import pytest

from quernstone import schema
from quernstone.sources import readers, sinks


def test_result_files(spark, tmp_path):
    sim = {"task_id": "7", "trial": 1, "messages": [{"role": "user", "content": "hi"}, {"role": "tool", "id": "c1", "error": True, "content": "no"}]}
    for n in (7, 8):
        (tmp_path / f"task_{n}").mkdir()
        (tmp_path / f"task_{n}" / "returned_results.json").write_text(json.dumps({"simulations": [sim]}, indent=2))
    files = readers.result_files(spark, str(tmp_path))
    assert sorted(r["task_dir"] for r in files.collect()) == [7, 8]
    assert [tuple(r) for r in readers.duplicate_tasks(files).collect()] == [("7", 2)]
    e = readers.result_events(files).where("role = 'tool'").first()
    assert e["tool_call_id"] == "c1" and e["tool_error"] and e["msg_index"] == 1


def test_json_lines_keep_faults(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"task_id": "1", "label": "PASS"}\n\n{"task_id": \n{"task_id": "2"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path), "task_id string, label string")
    assert sorted((r["task_id"], r["label"]) for r in good.collect()) == [("1", "PASS"), ("2", None)]
    assert [(r["line_number"], r["line"]) for r in bad.collect()] == [(3, '{"task_id": ')]


@pytest.mark.parametrize("text", ['[{"task_id": "1"}, {"task_id": "2"}]', '{"results": [{"task_id": "1"}, {"task_id": "2"}]}'])
def test_predictions(spark, tmp_path, text):
    (tmp_path / "p.json").write_text(text)
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("task_id", T.StringType())])
    assert sorted(r[0] for r in readers.predictions(spark, str(tmp_path), kind).collect()) == ["1", "2"]


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('task_id,label,reviewer_id,reviewed_at,rationale,evidence_files\n1,PASS,a,2031-01-01,"two\nlines","[""x.json""]"\n2,FAIL,a,2031-01-01,r,nothing\n')
    got = {r["task_id"]: r["evidence_files"] for r in readers.reviewer_sheet(spark, str(tmp_path)).collect()}
    assert got["1"] == ["x.json"] and not got["2"]


LOG = 'start\nStep 0.\nFrom role: Role.USER\ncontent: hello there\n\nStep 1.\nFrom role: agent\ncontent: wait\n\nToolCall (from assistant)\nid: c1\nname: get_order\narguments: {"a": 1}\n\nToolCall (from assistant)\nid: c2\nname: get_user\narguments: {broken\n\nStep 2.\nFrom role: env\ncontent: error=True nothing found\n'


def test_logs(spark, tmp_path):
    (tmp_path / "task.log").write_text(LOG)
    got = sorted((r["step"], r["role"], r["content"], r["tool_error"]) for r in readers.step_logs(spark, str(tmp_path)).collect())
    assert got == [(0, "user", "hello there", False), (1, "assistant", "wait", False), (2, "tool", "error=True nothing found", True)]
    made = sorted((r["step"], r["position"], r["call_id"], r["name"], r["arguments"]) for r in readers.logged_calls(spark, str(tmp_path)).collect())
    assert made == [(1, 0, "c1", "get_order", '{"a": 1}'), (1, 1, "c2", "get_user", None)]


def test_dumps_and_source_choice(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    (d / "task.log").write_text(LOG)
    (d / "1_agent_response.json").write_text(json.dumps({"request": {"messages": [{"role": "user", "content": "q"}]}, "response": {"content": "a"}}))
    assert [(r["msg_index"], r["role"], r["content"]) for r in readers.debug_dumps(spark, f"{d}/*.json").orderBy("msg_index").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    row = readers.newest_source(spark, str(tmp_path)).first()
    assert row["kind"] == "debug" and row["path"].endswith("1_agent_response.json")


def test_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"x\r\ny")
    assert readers.file_digests(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b"x\r\ny").hexdigest().upper()
    assert readers.file_digests(spark, str(tmp_path), line_ends=True).first()["sha256"] == hashlib.sha256(b"x\ny").hexdigest().upper()


def test_dataset_and_table(spark, tmp_path):
    d = spark.createDataFrame([("1", "TRAIN", True), ("2", "TEST", None)], "k string, split string, ok boolean")
    manifest = sinks.write_dataset(d, str(tmp_path / "out"), "k", "split")
    assert manifest["rows"] == 2 and manifest["splits"] == {"TRAIN": 1, "TEST": 1} and manifest["files"]
    with pytest.raises(Exception):
        sinks.write_dataset(d, str(tmp_path / "out"), "k")
    sinks.write_table(d, str(tmp_path / "csv"), ["ok", "k"])
    assert sorted(r[0] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["UNRESOLVED", "YES"]
    assert "- n: 2" in sinks.report(d.selectExpr("count(*) as n"), "T")


def test_schema_matches_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/message_events.parquet")
    assert [(f.name, f.dataType.simpleString()) for f in table.schema] == [(f.name, f.dataType.simpleString()) for f in schema.EVENT]


def test_directory_digest(spark, tmp_path):
    import hashlib

    from quernstone.sources.readers import directory_digest

    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "b.bin").write_bytes(b"\xff\r\n")
    (tmp_path / "d" / "sub" / "a.txt").write_bytes(b"x")
    want = hashlib.sha256(b"b.bin\0\xff\r\n\0sub/a.txt\0x\0").hexdigest().upper()
    assert tuple(directory_digest(spark, f"{tmp_path}/d").first()) == (2, want)
    assert readers.file_digests(spark, f"{tmp_path}/d/b.bin", line_ends=True).first()["sha256"] == hashlib.sha256(b"\xff\n").hexdigest().upper()


def test_first_log_by_path(spark, tmp_path):
    for name in ("b/task.log", "a/task.log"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("x")
    (tmp_path / "b" / "z.log").write_text("x")
    got = {r["directory"].rsplit("/", 1)[-1]: r["path"].rsplit("/", 1)[-1] for r in readers.newest_source(spark, str(tmp_path)).collect()}
    assert got == {"a": "task.log", "b": "task.log"}


def test_judge_logs_and_prompt_audits(spark, tmp_path):
    from quernstone.sources import audits

    (tmp_path / "j.jsonl").write_text('{"judge": "a", "prompt_tokens": 3, "cost": 0.5}\n{broken\n{"judge": "a", "prompt_tokens": 4}\n')
    got = {r["judge"]: (r["calls"], r["errors"], r["prompt_tokens"], r["cost"]) for r in audits.judge_rollup(audits.judge_calls(spark, f"{tmp_path}/j.jsonl")).collect()}
    assert got == {"a": (2, 0, 7, 0.5), None: (1, 1, None, None)}
    (tmp_path / "p.jsonl").write_text('{"task_id": "1", "seed": 2, "model": "m2", "passed": true}\n{"task_id": "1", "seed": 2, "model": "m1", "passed": false}\n{"task_id": "1", "seed": 3, "model": "m1", "passed": true}\n')
    assert sorted(tuple(r) for r in audits.prompt_audit_index(spark, f"{tmp_path}/p.jsonl").collect()) == [("1", 2, 2, False, "m1,m2"), ("1", 3, 1, True, "m1")]


def test_encodings(spark, tmp_path):
    from quernstone.sources import audits

    (tmp_path / "u.txt").write_bytes("\ufeffGrüße".encode())
    (tmp_path / "w.txt").write_bytes("Grüße".encode("windows-1252"))
    assert sorted((r["text"], r["encoding"]) for r in audits.files_as_text(spark, str(tmp_path)).collect()) == [("Grüße", "utf-8"), ("Grüße", "windows-1252")]
    texts = ["Grüße", "Grüße".encode().decode("windows-1252"), "don’t".encode().decode("windows-1252"), "plain", "日本", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(audits.mended("t")).collect()] == ["Grüße", "Grüße", "don’t", "plain", "日本", None]


def test_faulty_predictions(spark):
    from quernstone.sources import audits

    d = spark.createDataFrame([("1", "PASS"), ("2", "MAYBE"), ("3", "FAIL"), ("3", "PASS"), (None, "PASS")], "task_id string, label string")
    good, bad = audits.checked_predictions(d, ["PASS", "FAIL"])
    assert [tuple(r) for r in good.collect()] == [("1", "PASS")]
    assert sorted((r[0] or "", r[1]) for r in bad.collect()) == [("", "NO_KEY"), ("2", "UNKNOWN_LABEL"), ("3", "DUPLICATE"), ("3", "DUPLICATE")]


def test_trajectories_and_json_report(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/message_events.parquet")
    done = sinks.write_trajectories(events.dropDuplicates(["event_id"]), str(tmp_path / "t"))
    back = spark.read.json(str(tmp_path / "t"))
    assert done["failed"] == 0 and back.count() == done["written"] and "messages" in back.columns
    assert sinks.report_json(back.selectExpr("count(*) as n"), str(tmp_path / "r"))["n"] == done["written"]


def test_line_numbers_over_blocks(spark, tmp_path):
    lines = ['{"task_id": "%d"}' % i if i % 97 else "{broken %d" % i for i in range(1, 3_000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        _, bad = readers.json_lines(spark, str(tmp_path), "task_id string")
        assert sorted((r["line_number"], r["line"]) for r in bad.collect()) == [(i, "{broken %d" % i) for i in range(1, 3_000) if i % 97 == 0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dataset_is_checked_against_its_manifest(spark, tmp_path):
    d = spark.createDataFrame([("1",), ("2",)], "k string").coalesce(1)
    sinks.write_dataset(d, f"{tmp_path}/out", "k")
    assert sinks.check_dataset(spark, f"{tmp_path}/out").count() == 0
    part = next((tmp_path / "out").glob("part-*.json"))
    part.write_text('{"k":"3"}\n')
    (tmp_path / "out" / ("." + part.name + ".crc")).unlink()
    (tmp_path / "out" / "part-extra.json").write_text("{}\n")
    assert sorted(r["fault"] for r in sinks.check_dataset(spark, f"{tmp_path}/out").collect()) == ["CHANGED", "UNLISTED"]


def test_tables_begin_with_a_mark(spark, tmp_path):
    d = spark.createDataFrame([("1", True)], "k string, ok boolean").coalesce(1)
    sinks.write_table(d, f"{tmp_path}/a", ["ok", "k"])
    sinks.write_table(d, f"{tmp_path}/b", ["ok", "k"], mark=False)
    a, b = (next((tmp_path / n).glob("part-*.csv")).read_bytes() for n in "ab")
    assert a == b"\xef\xbb\xbf" + b and b == b"ok,k\nYES,1\n"
