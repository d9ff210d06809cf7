"""FASTA / CSV / JSON / append sources and sinks, streaming leader, facts of generated FASTA files."""
import os
import random
from collections import Counter

import numpy as np
import pytest

from seqspark.operators import kmers as K
from seqspark.sources import files as IO
from seqspark.streaming.leader import run_leader_stream



def write(path, text, mode="w"):
    with open(path, mode, newline="") as f:
        f.write(text)
    return str(path)


def test_fasta_multiline_crlf_no_final_newline(spark, tmp_path):
    p = write(tmp_path / "a.fasta", ">r1\r\nACG\r\nTT\r\n>r2 desc\r\nggcc")
    out = [tuple(r) for r in IO.read_fasta(spark, p).orderBy("row_idx").collect()]
    assert out == [(0, "r1", "ACGTT"), (1, "r2", "ggcc")]


def test_fasta_empty_file(spark, tmp_path):
    p = write(tmp_path / "e.fasta", "")
    assert IO.read_fasta(spark, p).count() == 0


def test_fasta_roundtrip_and_split_invariance(spark, tmp_path):
    seqs = [("".join("acgt"[(i * j) % 4] for j in range(81)),) for i in range(300)]
    df = spark.createDataFrame([(i, s) for i, (s,) in enumerate(seqs)], "k long, sequence string")
    path = str(tmp_path / "out")
    IO.write_fasta(df, path, ["k"], num_files=3)
    back = IO.read_fasta(spark, path).orderBy("row_idx").collect()
    assert [r["id"] for r in back] == [f"Sequence_{i + 1}" for i in range(300)]
    assert [r["sequence"] for r in back] == [s.upper() for (s,) in seqs]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")   # many splits per file
        again = IO.read_fasta(spark, path).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in again] == [tuple(r) for r in back]


def test_csv_required_columns(spark, tmp_path):
    df = spark.createDataFrame([("x", "ACGT", 1)], "id string, sequence string, label int")
    path = str(tmp_path / "csv")
    IO.write_csv(df, path, partition_by=["label"])
    back = IO.read_csv_checked(spark, path, "id string, sequence string, label int", ["id", "sequence"])
    assert [tuple(r) for r in back.collect()] == [("x", "ACGT", 1)]
    with pytest.raises(ValueError, match="seq_col"):
        IO.read_csv_checked(spark, path, "id string", ["id", "seq_col"])


def test_append_log_merges_new_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    IO.append_log(spark.createDataFrame([(1, 0.5)], "trial_id long, acc double"), path)
    IO.append_log(spark.createDataFrame([(2, 0.6, 0.1)], "trial_id long, acc double, loss double"), path)
    rows = sorted(tuple(r) for r in IO.read_log(spark, path).select("trial_id", "acc", "loss").collect())
    assert rows == [(1, 0.5, None), (2, 0.6, 0.1)]


def test_stream_leader_tie_breaks_by_event_order(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "trial_id long, fold long, epoch long, acc double"
    spark.createDataFrame([(2, 1, 1, 0.9), (2, 1, 2, 0.1)], schema).write.parquet(src + "/a")
    spark.createDataFrame([(1, 3, 1, 0.9), (1, 1, 1, float("nan"))], schema).write.parquet(src + "/b")
    for d in ("a", "b"):
        for f in os.listdir(f"{src}/{d}"):
            if f.endswith(".parquet"):
                os.replace(f"{src}/{d}/{f}", f"{src}/{d}-{f}")
    lead = run_leader_stream(spark, src, schema, str(tmp_path / "log"), str(tmp_path / "lead"),
                             str(tmp_path / "ck"), max_files_per_trigger=1).first()
    assert (lead["best_metric_value"], lead["trial_id"], lead["fold"]) == (0.9, 1, 3)


def corpus(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("AACGTT" if seed % 2 else "ACGT") for _ in range(81)) for _ in range(n)]


def test_kmer_facts_of_fasta_files(spark, tmp_path):
    """Two FASTA files (wrapped lines, CRLF, lower case): counts and k-mer r equal a plain count of the same strings."""
    a, b = corpus(1, 120), corpus(2, 90) + corpus(2, 5)
    pa = write(tmp_path / "a.fasta", "".join(f">s{i} note\n{s[:60]}\n{s[60:]}\n" for i, s in enumerate(a)))
    pb = write(tmp_path / "b.fasta", "".join(f">s{i}\r\n{s}\r\n" for i, s in enumerate(b)))
    da, db = IO.read_fasta(spark, pa), IO.read_fasta(spark, pb)
    assert [r["sequence"] for r in da.orderBy("row_idx").collect()] == a and db.count() == 95
    assert db.select("sequence").distinct().count() == len(set(b))
    for k in (3, 6):
        ca, cb = (Counter(s[i:i + k] for s in x for i in range(82 - k)) for x in (a, b))
        keys = sorted(set(ca) | set(cb))
        want = np.corrcoef([ca[x] / sum(ca.values()) for x in keys], [cb[x] / sum(cb.values()) for x in keys])[0, 1]
        got = K.kmer_correlation(da, db, k).first()
        assert got["r"] == pytest.approx(want, abs=1e-9) and got["n_kmers"] == len(keys)


def test_core_facts_of_generated_rows(spark):
    """Rows that keep, lose or permute the core cells of a corpus are counted as such."""
    from seqspark.operators import regions as R
    nat = corpus(3, 60)
    inside = [any(lo <= i < hi for lo, hi in R.SHIPPED_REGIONS) for i in range(81)]
    keep = ["".join(c if k else "N" for c, k in zip(s, inside)) for s in nat]
    lose = ["".join("N" if k else c for c, k in zip(s, inside)) for s in nat]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "row_idx long, sequence string")
    assert R.core_kept_rows(R.pair_by_index(frame(keep), frame(nat)), R.SHIPPED_REGIONS).first()["n_core_kept"] == 60
    assert R.core_kept_rows(R.pair_by_index(frame(lose), frame(nat)), R.SHIPPED_REGIONS).first()["n_core_kept"] == 0
    turned = keep[1:] + keep[:1]
    cores = [sorted(r[0] for r in frame(x).select(R.core_slice("sequence", R.SHIPPED_REGIONS)).collect()) for x in (nat, turned)]
    assert cores[0] == cores[1]


def test_stream_log_is_complete(spark, tmp_path):
    src = str(tmp_path / "src2")
    schema = "trial_id long, fold long, epoch long, acc double"
    spark.createDataFrame([(i, 1, 1, i / 10) for i in range(7)], schema).repartition(3).write.parquet(src)
    run_leader_stream(spark, src, schema, str(tmp_path / "log2"), str(tmp_path / "lead2"), str(tmp_path / "ck2"),
                      max_files_per_trigger=1)
    log = spark.read.parquet(str(tmp_path / "log2"))
    assert log.count() == 7 and log.select("batch_id").distinct().count() >= 2


@pytest.mark.parametrize("parts", [[1, 1], [2, 5, 1]])
def test_fold_best_stream_for_any_split_and_restart(spark, tmp_path, parts):
    """Events in any order over several files and restarts: the last versions equal one pass over all events."""
    from seqspark.streaming.foldbest import latest, run_fold_best_stream
    rnd = random.Random(len(parts))
    schema = "trial_id long, fold long, epoch long, acc double, note string"
    rows = [(t, f, e, rnd.choice([None, float("nan"), rnd.randint(1, 6) / 10, rnd.randint(1, 6) / 10]), "x")
            for t in (1, 2, None) for f in (1, 2) for e in range(1, 12)] + [(9, 1, 1, None, "x"), (9, 1, 2, float("nan"), "x")]
    rnd.shuffle(rows)
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    step = -(-len(rows) // len(parts))
    for i, n in enumerate(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).repartition(n).write.mode("append").parquet(src)
        run_fold_best_stream(spark, src, schema, out, ckpt, max_files_per_trigger=2)
    run_fold_best_stream(spark, src, schema, out, ckpt)                 # nothing new: nothing changes
    got = {(r["trial_id"], r["fold"]): r for r in latest(spark, out).collect()}
    want = {}
    for t, f, e, a, _ in rows:
        want.setdefault((t, f), []).append((e, a))
    assert set(got) == set(want)
    for k, ev in want.items():
        ok = [(-a, e) for e, a in ev if a is not None and a == a]
        r = got[k]
        assert (r["n_events"], r["n_valid"], r["last_epoch"]) == (len(ev), len(ok), max(e for e, _ in ev))
        assert (r["best"], r["epoch"]) == ((-min(ok)[0], min(ok)[1]) if ok else (None, None))
    assert sum(r["n_late"] for r in got.values()) > 0
    assert spark.read.parquet(out).groupBy("trial_id", "fold", "version").count().where("count > 1").count() == 0


def test_stream_batches_do_not_grow_with_the_events(spark, tmp_path):
    """However many partitions the events have, each half is streamed in two batches."""
    import glob

    from seqspark.plans import q_io
    rows = [(i, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", i % 7, "abc"[i % 3], float(i % 50)) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    seen = {}
    scratch, log = q_io.IO.scratch_path, q_io.V.eval_log
    q_io.IO.scratch_path = lambda s, n: seen.setdefault(n, f"{tmp_path}/{n}")
    q_io.V.eval_log = lambda s, sf: log(s, sf).repartition(40)
    try:
        assert q_io.q_stream_fold_best(spark, str(tmp_path)).count() == 21
    finally:
        q_io.IO.scratch_path, q_io.V.eval_log = scratch, log
    assert len(glob.glob(f"{seen['fold-checkpoint']}/commits/[0-9]*")) <= 4
