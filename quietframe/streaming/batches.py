"""A private stream answered batch by batch.

An extension: a release is a batch job, so each micro-batch is a session of its own.
A row is in one batch, so row protection composes in parallel and each batch may use
the whole budget; IDs can come back in later batches, so their budget is divided over
the batches that are allowed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..budgets import Budget
from ..plans.nodes import Query
from ..protection import AddRowsWithID, ProtectedChange
from ..session import Session


def answer_each_batch(stream: DataFrame, query: Query, source_id: str, change: ProtectedChange, budget: Budget, sink: Callable[[DataFrame, int], None], max_batches: int | None = None):
    """A writer (call start()) that hands `sink` the answer for each batch.  IDs need
    max_batches; batches beyond it are not answered."""
    if isinstance(change, AddRowsWithID):
        if not max_batches:
            raise ValueError("a stream with IDs needs max_batches")
        budget = budget / max_batches

    def run(batch: DataFrame, number: int) -> None:
        if max_batches is not None and number >= max_batches:
            return
        sink(Session.from_dataframe(budget, source_id, batch, change).evaluate(query, budget), number)

    return stream.writeStream.foreachBatch(run)
