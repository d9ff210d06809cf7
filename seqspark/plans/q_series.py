"""Training-series queries over the ``loss_log`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import series as S
from seqspark.plans.catalog import register
from seqspark.sources import driver_tables as V

# Query parameters: the event-derived runs are ~17 epochs long, so the EMA, LR and
# checkpoint cadences are scaled to that length (the reference defaults stay the
# operator defaults).
EMA_DECAY, EMA_START, EMA_RATE = 0.8, 4, 2
LR_STEP = 5
CKPT_RATE = 5

SQL_EPOCH = """el AS (
  SELECT run, epoch, avg(bm) AS val_loss, count(*) AS n_batches
  FROM (SELECT run, epoch, batch, avg(loss) AS bm FROM loss_log GROUP BY run, epoch, batch)
  GROUP BY run, epoch)"""


def epochs(spark, sf):
    return S.epoch_loss(V.loss_log(spark, sf))


@register("epoch_loss", V.with_views(f"""WITH {SQL_EPOCH}
SELECT run, epoch, round(val_loss, 9) AS val_loss, n_batches FROM el""", "loss_log"))
def q_epoch_loss(spark, sf):
    return epochs(spark, sf).select("run", "epoch", F.round("val_loss", 9).alias("val_loss"), "n_batches")


@register("best_checkpoints", V.with_views(f"""WITH {SQL_EPOCH}
SELECT run, epoch, round(val_loss, 9) AS val_loss,
       coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY epoch
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best
FROM el""", "loss_log"))
def q_best_checkpoints(spark, sf):
    b = S.best_checkpoints(epochs(spark, sf))
    return b.select("run", "epoch", F.round("val_loss", 9).alias("val_loss"), "is_best")


@register("early_stop", V.with_views(f"""WITH {SQL_EPOCH},
w AS (SELECT run, epoch, count(*) OVER win AS n, min(val_loss) OVER win AS lo, max(val_loss) OVER win AS hi
      FROM el WINDOW win AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN {S.EARLY_STOP_WINDOW - 1} PRECEDING AND CURRENT ROW))
SELECT run, min(epoch) FILTER (WHERE n >= {S.EARLY_STOP_WINDOW} AND hi <> 0 AND (hi - lo) / hi < {S.EARLY_STOP_TOL}) AS stop_epoch,
       count(*) AS n_epochs,
       coalesce(min(epoch) FILTER (WHERE n >= {S.EARLY_STOP_WINDOW} AND hi <> 0 AND (hi - lo) / hi < {S.EARLY_STOP_TOL}), count(*)) AS epochs_trained
FROM w GROUP BY run""", "loss_log"))
def q_early_stop(spark, sf):
    return S.early_stop(epochs(spark, sf))


@register("ema_series", V.with_views(f"""WITH RECURSIVE {SQL_EPOCH},
r AS (
  SELECT run, epoch, val_loss, CASE WHEN 1 % {EMA_RATE} = 0 THEN val_loss END AS ema FROM el WHERE epoch = 1
  UNION ALL
  SELECT e.run, e.epoch, e.val_loss,
         CASE WHEN e.epoch % {EMA_RATE} <> 0 THEN r.ema
              WHEN e.epoch < {EMA_START} OR e.epoch = {EMA_RATE} OR r.ema IS NULL THEN e.val_loss
              ELSE r.ema * {EMA_DECAY} + (1 - {EMA_DECAY}) * e.val_loss END
  FROM r JOIN el e ON e.run = r.run AND e.epoch = r.epoch + 1)
SELECT run, epoch, round(val_loss, 9) AS val_loss, round(ema, 9) AS ema FROM r""", "loss_log"))
def q_ema_series(spark, sf):
    e = S.ema_series(epochs(spark, sf), "val_loss", "epoch", ["run"], decay=EMA_DECAY,
                     rate=EMA_RATE, start=EMA_START)
    return e.select("run", "epoch", F.round("val_loss", 9).alias("val_loss"), F.round("ema", 9).alias("ema"))


@register("lr_schedule", V.with_views(f"""WITH {SQL_EPOCH}
SELECT run, epoch, {S.LR0} * pow({S.LR_GAMMA}, floor((epoch - 1) / {LR_STEP})) AS lr FROM el""", "loss_log"))
def q_lr_schedule(spark, sf):
    return epochs(spark, sf).select("run", "epoch", S.lr_at_epoch("epoch", step=LR_STEP).alias("lr"))


@register("checkpoint_epochs", V.with_views(f"""WITH {SQL_EPOCH}
SELECT run, epoch, round(val_loss, 9) AS val_loss FROM el WHERE epoch % {CKPT_RATE} = 0""", "loss_log"))
def q_checkpoint_epochs(spark, sf):
    c = S.checkpoint_epochs(epochs(spark, sf), CKPT_RATE)
    return c.select("run", "epoch", F.round("val_loss", 9).alias("val_loss"))
