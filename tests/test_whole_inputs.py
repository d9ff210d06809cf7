"""Rows that small fixtures never hold: line ends, other column orders, many event types, a restarted stream, given settings."""
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqspark.functions.dna import clean_dna
from seqspark.operators import clean as C
from seqspark.operators import metrics as M
from seqspark.plans import q_experiments, q_io
from seqspark.sources import driver_tables as V
from seqspark.sources import files as IO
from seqspark.streaming.leader import run_leader_stream

BLANKS = ["\n", "\r\n", "\r", "\u2028", "\u2029", "\x85", "\t", " ", "\xa0", "\x1c", "\x0b", "\x0c", "\u3000"]


def test_clean_dna_equals_python_on_every_blank(spark):
    texts = [t for b in BLANKS for t in (b, f"ACGT{b}", f"{b}ACGT", f"AC{b}GT", f"acg{b}x")]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", clean_dna("s").alias("c")).collect()
    for r in got:
        want = "".join(c if c in "ACGTN" else "N" for c in "".join(r["s"].upper().split()))
        assert r["c"] == want, repr(r["s"])


def test_crlf_sheet_keeps_its_rows(spark):
    rows = [(f"i{i}", ("ACGT"[i % 4] + "ACGTT" * 16) + "\r", i % 2, "s", 0, i) for i in range(4)]
    df = spark.createDataFrame(rows, "id string, sequence string, label int, source_sheet string, source_rank int, row_order long")
    assert sorted(r["id"] for r in C.clean_pipeline(df, 81).collect()) == ["i0", "i1", "i2", "i3"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,other,sequence\n1,x,ACGT\nbad,y,GG\n")
    got = IO.read_csv_checked(spark, str(tmp_path / "a.csv"), "sequence string, label int, absent string", ["sequence"]).collect()
    assert [tuple(r) for r in got] == [("ACGT", 1, None), ("GG", None, None)]
    with pytest.raises(ValueError, match="absent"):
        IO.read_csv_checked(spark, str(tmp_path / "a.csv"), "sequence string", ["sequence", "absent"])


@pytest.mark.parametrize("n_types", [6, 2000])
def test_any_number_of_event_types(spark, tmp_path, n_types):
    rows = spark.range(n_types * 2).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 3).alias("user_id"),
        F.when(F.col("id") % n_types > 0, F.format_string("t%05d", (F.col("id") % n_types).cast("int"))).alias("event_type"),
        (F.col("id") * 1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    ev = V.eval_log(spark, str(tmp_path))
    assert ev.count() == 2 * n_types and sorted({r[0] for r in ev.select("fold").collect()}) == list(range(1, n_types + 1))
    assert q_io.q_append_log(spark, str(tmp_path)).count() == 2 * n_types
    assert q_experiments.q_acc_from_metrics(spark, str(tmp_path)).count() == 2 * n_types


def test_tile_ids_do_not_meet(spark):
    df = spark.createDataFrame([(1, 1_000_000), (2, 0), (2 ** 62, 3), (0, 12)], "doc_id long, tile int")
    ids = [r[0] for r in df.orderBy("doc_id", "tile").select(V.tile_id("doc_id")).collect()]
    assert len(set(ids)) == 4 and ids == sorted(ids)


def test_leader_survives_a_restart(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "trial_id long, fold long, epoch long, acc double"
    args = (src, schema, f"{tmp_path}/log", f"{tmp_path}/lead", f"{tmp_path}/ck")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([(1, 1, 1, None), (1, 1, 2, float("nan"))])
    assert run_leader_stream(spark, *args).count() == 0          # no valid event yet
    write([(1, 2, 1, 0.9)])
    assert run_leader_stream(spark, *args).first()["best_metric_value"] == 0.9
    write([(1, 3, 1, 0.5)])
    lead = run_leader_stream(spark, *args).first()               # a worse event after the restart
    assert (lead["best_metric_value"], lead["fold"]) == (0.9, 2)
    write([(2, 1, 1, 0.95)])
    assert run_leader_stream(spark, *args).first()["trial_id"] == 2


def test_model_selection_by_alias(spark):
    reg = M.registry(spark)
    assert [r["key"] for r in M.select_models(reg, "gemma_no_prompt").collect()] == ["gemma"]
    assert [r["key"] for r in M.select_models(reg, "nt").collect()] == ["nt"] and M.select_models(reg).count() == 4
    res = spark.createDataFrame([("nt", 0.5, 2)], "model string, acc double, n long")
    status = {r["key"]: (r["status"], r["acc"]) for r in M.model_summary(reg, res).collect()}
    assert status["nt"] == ("OK", 0.5) and status["gemma"] == ("FAILED", None)


def test_session_keeps_submitted_settings():
    code = ("import json; from seqspark.session import get_session; s = get_session(); "
            "print(json.dumps([s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions')]))")
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.sql.shuffle.partitions=37 pyspark-shell",
           "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert json.loads(out.stdout.strip().splitlines()[-1]) == ["local[2]", "37"], out.stderr[-500:]
