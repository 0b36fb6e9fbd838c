"""Batched lookups: answers come per batch, by position, and a batch whose answers can't be told apart is refused as a whole.

Two ways to ask: ``zipped`` takes answers from a table, ``asked`` calls a function on the executors. Both give one row per request, an answer
or a failure, and try a batch again as often as they are told to.
"""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed codes of batches and requests without an answer.
LENGTH, ABSENT, TIMEOUT = "batch_length_mismatch", "batch_response_missing", "batch_timed_out"


def zipped(requests: DataFrame, answers: DataFrame, batch: list[str], order: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """The requests with position, answer, attempt and failure; and the batches of answers that nobody asked for.

    ``requests``: the batch's columns and an order in it. ``answers``: the batch's columns, attempt (from 1 on), position (its order), answer,
    and failure (a code, or null). The first attempt without a failure that has as many answers as there are requests is taken, in order; of
    the others up to ``most`` the last one's code tells why there is none. Batches without answers are absent; null batches match each other.
    """
    w = Window.partitionBy(*batch)
    asked = requests.withColumn("position", F.row_number().over(w.orderBy(order)))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in batch]
    sizes = requests.groupBy(*batch).agg(F.count("*").alias("wanted"))
    tried = answers.where(F.col("attempt") <= most).groupBy(*batch, "attempt").agg(F.count("*").alias("given"), F.max("failure").alias("failure"))
    met = tried.join(sizes, same(tried, sizes), "left").select(*[tried[c] for c in batch], "attempt", "given", "failure", "wanted")
    code = F.coalesce("failure", F.when(F.col("given") != F.col("wanted"), LENGTH))
    told = met.where("wanted IS NOT NULL").withColumn("code", code).groupBy(*batch).agg(F.min(F.when(F.col("code").isNull(), F.col("attempt"))).alias("sound"), F.max("attempt").alias("last"), F.max_by("code", "attempt").alias("code"))
    strangers = met.where("wanted IS NULL").select(*batch).distinct()
    out = asked.join(told, same(asked, told), "left").select(*[asked[c] for c in asked.columns], "sound", "last", "code")
    ranked = answers.withColumn("__position", F.row_number().over(Window.partitionBy(*batch, "attempt").orderBy("position"))).select(*[F.col(c).alias(f"__{c}") for c in batch], F.col("attempt").alias("__attempt"), "__position", "answer")
    on = [out[c].eqNullSafe(ranked[f"__{c}"]) for c in batch] + [out["sound"] == ranked["__attempt"], out["position"] == ranked["__position"]]
    failure = F.when(F.col("sound").isNull(), F.coalesce("code", F.lit(ABSENT)))
    return out.join(ranked, on, "left").select(*requests.columns, "position", F.col("answer"), F.coalesce("sound", "last").alias("attempt"), failure.alias("failure")), strangers


def _tried(ask: Callable[[list], list], requests: list, most: int, seconds: float) -> tuple[list, int, str | None]:
    code = None
    for attempt in range(1, most + 1):
        # A call that doesn't return in time is left to its thread: nothing waits for it.
        pool = concurrent.futures.ThreadPoolExecutor(1)
        try:
            found = list(pool.submit(ask, requests).result(seconds))
            if len(found) == len(requests):
                return found, attempt, None
            code = LENGTH
        except concurrent.futures.TimeoutError:
            code = TIMEOUT
        except Exception as e:  # any failure of a lookup is a row
            code = type(e).__name__
        finally:
            pool.shutdown(wait=False)
    return [None] * len(requests), most, code


def asked(requests: DataFrame, ask: Callable[[list], list], batch: list[str], order: str, request: str = "request", rows: int = 64, most: int = 3, seconds: float = 30.0) -> DataFrame:
    """The requests with answer, attempt and failure: ``ask`` gets the requests of a batch in order, and returns as many texts.

    A batch holds at most ``rows`` requests of the same ``batch`` columns, so a hot one is dealt to many tasks. Each is tried up to ``most``
    times for ``seconds`` each; then each of its requests fails by the last code: the class of what was raised, a time limit, a wrong length.
    """
    number = F.floor((F.row_number().over(Window.partitionBy(*batch).orderBy(order)) - 1) / rows)
    schema = T.StructType([*requests.schema.fields, T.StructField("answer", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("failure", T.StringType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").drop(columns="__batch")
        answers, attempt, failure = _tried(ask, frame[request].tolist(), most, seconds)
        return frame.assign(answer=answers, attempt=attempt, failure=failure)

    return requests.withColumn("__batch", number).groupBy(*batch, "__batch").applyInPandas(run, schema)


def correction_outcomes(targets: DataFrame, proven: Column, reproof: Column, ineligible: Column) -> DataFrame:
    """The targets with proposal, method, outcome and code, each decided for itself: the deterministic proposal first, else the answer.

    ``targets`` have answer and failure of their lookup. An ineligible target is rejected by its code and a lookup's failure fails it; a proposal
    of either kind has to stand the ``reproof`` (of column ``proposal``), else it is rejected.
    """
    told = targets.withColumns({"proposal": F.coalesce(proven, F.col("answer")), "method": F.when(ineligible.isNotNull(), F.lit(None)).when(proven.isNotNull(), "deterministic").otherwise("lookup"), "__ineligible": ineligible})
    lost = F.col("proposal").isNull()
    outcome = F.when(F.col("__ineligible").isNotNull(), "rejected").when(lost, "failed").when(F.coalesce(reproof, F.lit(False)), "accepted").otherwise("rejected")
    code = F.coalesce("__ineligible", F.when(lost, F.coalesce("failure", F.lit(ABSENT))), F.when(~F.coalesce(reproof, F.lit(False)), "proposal_not_proven"))
    return told.withColumns({"outcome": outcome, "code": code}).withColumn("proposal", F.when(F.col("outcome") == "accepted", F.col("proposal"))).drop("__ineligible")
