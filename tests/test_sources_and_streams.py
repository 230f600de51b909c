"""Files in, files out, and streams equal to their batch results."""

import json

from pyspark.sql import functions as F

from cueloom.operators import catalog as ct
from cueloom.sources import ingest, sinks
from cueloom.streaming import jobs


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\n[Anna] Hello\nthere\n\n2\nbroken\n\n3\n00:01.000 --> 00:02.000\n\n", encoding="utf-8")
    (tmp_path / "b.vtt").write_text("﻿WEBVTT\n\nNOTE skip\n\n00:05.000 --> 00:06.000 align:start\n<v Bob>Hi</v>\n", encoding="utf-8")
    rows = {r["media_id"]: r for r in ingest.load_dataset(spark, "subtitles", str(tmp_path)).collect()}
    assert (rows["a"]["start_ms"], rows["a"]["end_ms"], rows["a"]["speaker_label"], rows["a"]["text"]) == (1000, 2500, "Anna", "Hello there")
    assert (rows["b"]["start_ms"], rows["b"]["speaker_label"], rows["b"]["text"]) == (5000, "Bob", "Hi")


def test_rttm_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, 1500, "spk1"), (1, 1500, 3800, "spk2")], "media_id long, start_ms long, end_ms long, speaker string")
    sinks.write_text(sinks.rttm_lines(turns), str(tmp_path / "out"), "start_ms")
    back = ingest.parse_rttm(spark.read.text(str(tmp_path / "out")).select("media_id", "value"))
    assert sorted((r["start_ms"], r["end_ms"], r["speaker"]) for r in back.collect()) == [(0, 1500, "spk1"), (1500, 3800, "spk2")]


def test_json_payloads_and_listing(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"results": [{"start_time": 2.0, "end_time": 1.0, "text": " x "}, {"text": ""}]}))
    event = ingest.parse_events(ingest.read_whole(spark, str(tmp_path))).collect()
    assert [(e["event_id"], e["start_ms"], e["end_ms"], e["text"], e["confidence"]) for e in event] == [("evt-0001", 1000, 2000, "x", 1.0)]
    assert [r["size_bytes"] > 0 for r in ingest.list_files(spark, str(tmp_path)).collect()] == [True]


def test_jsonl_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for part in range(3):
        lines = [json.dumps({"media_id": 1, "target_id": i % 2, "seq": part * 10 + i, "op": ["set_text", "approve"][i % 2], "payload": json.dumps({"k": part * 10 + i})}) for i in range(4)]
        (folder / f"{part}.jsonl").write_text("\n".join([*lines, "{broken"]))
    schema = "target_id BIGINT, seq BIGINT, op STRING, payload STRING"

    def state(lines):
        return jobs.op_log_state(ingest.parse_jsonl(lines.withColumn("media_id", F.lit(1)), schema, "seq"))

    key = ["media_id", "target_id", "field"]
    streamed = jobs.run_keyed(spark, "test-log", state(spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).select("value")), key)
    batch = state(spark.read.text(str(folder)).select("value"))
    assert sorted(map(tuple, streamed.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_change_log_skips_unchanged_rows(spark, tmp_path):
    src = tmp_path / "in"
    schema = "task_id long, stage string, status string, progress long, ts timestamp, seq long"
    for i, status in enumerate(["running", "running", "done"]):
        spark.sql(f"SELECT 1L task_id, 's' stage, '{status}' status, 5L progress, timestamp'2024-01-01 00:00:0{i}' ts, {i}L seq").coalesce(1).write.mode("append").parquet(str(src))
    folder = str(tmp_path / "out")
    stream = jobs.stage_status(jobs.file_stream(spark, str(src), schema, files_per_trigger=1))
    jobs.changes_to(stream, folder, ["task_id", "stage"]).awaitTermination()
    assert spark.read.parquet(f"{folder}/rows").count() <= 2
    assert jobs.latest(spark, folder, ["task_id", "stage"]).first()["status"] == "done"


def test_eviction_and_tasks(spark):
    rows = [("r", i, i * 1000, 10, i == 0) for i in range(5)]
    df = spark.createDataFrame(rows, "root string, output_id long, mtime_ms long, size_bytes long, referenced boolean")
    assert sorted(r["output_id"] for r in ct.evict_oldest(df, "root", 25, None, slot_ms=1500).collect()) == [1, 2, 3]
    tasks = spark.createDataFrame([(1, '{"pipeline":{"template":"asr-commentary"}}'), (2, None), (3, '{"output_intent":"commentary_recap"}')], "task_id long, config string")
    assert [r["task_id"] for r in ct.filter_tasks(tasks, intent="dub").collect()] == [2]
