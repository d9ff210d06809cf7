"""L3 isolation (J6): every model is validated in its own thread and job group; a failure stays its own.

Whatever a model's job raises, while it is built or while Spark runs it, becomes its FAILED row; the other
models' jobs run on.  Results are one row per model.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

RESULT = "model string, acc double, n long, error string"


def validate_models(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], parallelism: int = 4) -> DataFrame:
    """(model, acc, n, error): ``jobs[model]()`` returns one row with acc and n; error is null where it succeeded.

    A job that returns no row, or several, has failed as well.
    """
    def one(model: str):
        sc = spark.sparkContext
        sc.setJobGroup(f"validate-{model}", f"validation of {model}", interruptOnCancel=True)
        try:
            rows = jobs[model]().select("acc", "n").take(2)
            if len(rows) != 1:
                raise ValueError(f"{len(rows)} result rows")
            return model, rows[0]["acc"], rows[0]["n"], None
        except Exception as e:  # noqa: BLE001  (any failure is the model's result)
            return model, None, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(one), jobs))
    return spark.createDataFrame(results, RESULT)
