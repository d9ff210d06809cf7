"""Views over the driver's parquet tables, as Spark DataFrames and as SQL CTEs.

Each view exists twice: a DataFrame builder (used by the Spark queries) and a
DuckDB/ANSI SQL common-table expression (used by the oracle SQL).  They must
stay semantically identical.

Whole texts are used: a document's ASCII letters are re-coded to bases and the
full string is cut into consecutive 81-base tiles (the last tile of a document
may be shorter), so every base of every labelled document is a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.functions.dna import ALPHABET, ALPHABET_BASES, recode_letters, tiles
from seqspark.operators.rowindex import with_row_index

TILE = 81
STEPS_PER_EPOCH = 4


def tile_id(doc: str, tile: str = "tile"):
    """Id of a tile: both numbers in full, padded so that ids sort like (doc, tile)."""
    return F.concat(F.lpad(F.col(doc).cast("string"), 20, "0"), F.lit("-"), F.lpad(F.col(tile).cast("string"), 10, "0"))


def sql_tile_id(doc: str, tile: str = "t") -> str:
    return f"lpad({doc}::VARCHAR, 20, '0') || '-' || lpad({tile}::VARCHAR, 10, '0')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Spark views
def promoters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """promoters(id, doc_id, tile, sequence, label): tiles of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    # re-code before the join: if labels is too large to broadcast, the shuffle
    # carries the compact letter string instead of the raw text
    letters = docs.select("doc_id", recode_letters("text").alias("letters"))
    t = letters.join(labels, "doc_id").select("doc_id", "label", "letters")
    t = t.select("doc_id", "label", F.posexplode(tiles("letters", TILE)).alias("tile", "sequence"))
    return t.select(tile_id("doc_id").alias("id"),
                    "doc_id", F.col("tile").cast("int").alias("tile"), "sequence", "label")


def promoters_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """promoters_raw(id, sequence): documents.text unchanged."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"),
                                                    F.col("text").alias("sequence"))


def generated(spark: SparkSession, sf_dir: str, indexed: bool = True) -> DataFrame:
    """generated(row_idx, id, sequence): benchmark texts re-coded and tiled, ordered by (item, tile).

    ``indexed=False`` skips the positional index for consumers that only need (id, sequence).
    """
    b = table(spark, sf_dir, "benchmark").select("item_id", recode_letters("text").alias("letters"))
    b = b.select("item_id", F.posexplode(tiles("letters", TILE)).alias("tile", "sequence"))
    b = b.select(tile_id("item_id").alias("id"), "sequence")
    return with_row_index(b, ["id"]) if indexed else b


def hash_bases(id_col: str = "id"):
    """81 uniform pseudo-random bases per id: three md5 digests read as A/C/G/T."""
    def hx(i):
        return F.translate(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{i}"))),
                           "0123456789abcdef", "ACGTACGTACGTACGT")
    return F.substring(F.concat(hx(0), hx(1), hx(2)), 1, TILE)


def hashdna(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """hashdna(id, sequence): a uniform random corpus, one sequence per id (default: promoter ids)."""
    p = ids if ids is not None else promoters(spark, sf_dir).select("id")
    return p.select("id", hash_bases("id").alias("sequence"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matrix(vec_id, x): the embedding as a double array."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval_log(trial_id, fold, epoch, acc): events as an experiment's evaluation events.

    user -> trial, event_type -> fold (1-based alphabetical rank), order of ts inside
    (user, type) -> epoch (1-based), value / 1000 -> accuracy.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    ev = with_row_index(ev, ["ts", "event_id"], partition_by=["user_id", "event_type"],
                        name="epoch", start=1)
    return _with_fold(ev).select(F.col("user_id").alias("trial_id"), "fold", "epoch",
                                 (F.col("value") / 1000.0).alias("acc"))


def eval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eval_log without the numbered epoch: ``at`` = (ts, event_id) orders the events of a fold; no index is made."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return _with_fold(ev).select(F.col("user_id").alias("trial_id"), "fold", F.struct("ts", "event_id").alias("at"),
                                 (F.col("value") / 1000.0).alias("acc"))


def trial_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id")).distinct()


def _with_fold(ev: DataFrame) -> DataFrame:
    """fold = 1-based rank of the event type among the sorted distinct types (null last), from a dictionary table."""
    types = with_row_index(ev.select("event_type").distinct(), [F.col("event_type").asc_nulls_last()], name="fold", start=1)
    types = types.select(F.col("event_type").alias("_type"), "fold")
    return ev.join(types, F.col("event_type").eqNullSafe(F.col("_type"))).drop("_type")


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loss_log(run, step, epoch, batch, loss): events as per-batch training losses.

    user -> run, order of ts -> step (1-based), 4 batches per epoch, value / 100 -> loss.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    ev = with_row_index(ev, ["ts", "event_id"], partition_by=["user_id"], name="step", start=1)
    return ev.select(F.col("user_id").alias("run"), "step",
                     (F.floor((F.col("step") - 1) / STEPS_PER_EPOCH) + 1).cast("bigint").alias("epoch"),
                     ((F.col("step") - 1) % STEPS_PER_EPOCH).cast("bigint").alias("batch"),
                     (F.col("value") / 100.0).alias("loss"))


# ---------------------------------------------------------------- SQL twins
SQL_RECODE = (f"translate(regexp_replace(lower({{x}}), '[^a-z]', '', 'g'), "
              f"'{ALPHABET}', '{ALPHABET_BASES}')")

SQL_VIEWS = {
    "promoters": f"""promoters AS (
  SELECT {sql_tile_id('doc_id')} AS id, doc_id, t::INTEGER AS tile,
         substr(letters, (t * {TILE} + 1)::BIGINT, {TILE}) AS sequence, label
  FROM (SELECT doc_id, letters, label,
               unnest(range(0, ceil(length(letters) / {TILE}.0)::BIGINT)) AS t
        FROM (SELECT d.doc_id, {SQL_RECODE.format(x='d.text')} AS letters, l.quality AS label
              FROM documents d JOIN labels l USING (doc_id))))""",
    "promoters_raw": """promoters_raw AS (SELECT doc_id AS id, text AS sequence FROM documents)""",
    "generated": f"""generated AS (
  SELECT id, sequence, row_number() OVER (ORDER BY id) - 1 AS row_idx
  FROM (SELECT {sql_tile_id('item_id')} AS id,
               substr(letters, (t * {TILE} + 1)::BIGINT, {TILE}) AS sequence
        FROM (SELECT item_id, letters,
                     unnest(range(0, ceil(length(letters) / {TILE}.0)::BIGINT)) AS t
              FROM (SELECT item_id, {SQL_RECODE.format(x='text')} AS letters FROM benchmark))))""",
    "hashdna": f"""hashdna AS (
  SELECT id, substr(concat(translate(md5(concat(id::VARCHAR, '#0')), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                          translate(md5(concat(id::VARCHAR, '#1')), '0123456789abcdef', 'ACGTACGTACGTACGT'),
                          translate(md5(concat(id::VARCHAR, '#2')), '0123456789abcdef', 'ACGTACGTACGTACGT')),
                   1, {TILE}) AS sequence
  FROM promoters)""",
    "matrix": """matrix AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)""",
    "eval_log": """eval_log AS (
  SELECT user_id AS trial_id, dense_rank() OVER (ORDER BY event_type) AS fold,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS epoch,
         value / 1000.0 AS acc
  FROM events)""",
    "loss_log": f"""loss_log AS (
  SELECT run, step, (step - 1) // {STEPS_PER_EPOCH} + 1 AS epoch, (step - 1) % {STEPS_PER_EPOCH} AS batch, loss
  FROM (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
               value / 100.0 AS loss FROM events))""",
}

# views that other views depend on
_DEPS = {"hashdna": ["promoters"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    ctes = ",\n".join(SQL_VIEWS[n] for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
