"""Streaming forms: folding selection events, and layout extraction per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueglass.config import DEFAULT, Limits
from cueglass.operators.selection import Runs, apply_event
from cueglass.plans.extract import extract_layout
from cueglass.sources.readers import ocr_texts, ocr_words


def _update(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    known = {event[0]: event for event in zip(*state.get)} if state.exists else {}
    for batch in batches:
        stops = batch["to_index"].astype("Int64")
        for seq, op, start, stop in zip(batch["seq"], batch["op"], batch["from_index"], stops):
            event = int(seq), op, int(start), None if pd.isna(stop) else int(stop)
            known.setdefault(event[0], event)
    events = [known[seq] for seq in sorted(known)]
    selected = Runs()
    for _, op, start, stop in events:
        apply_event(selected, op, start, stop)
    state.update(tuple(list(column) for column in zip(*events)))
    words = [w for first, last in zip(selected.starts, selected.ends) for w in range(first, last + 1)]
    yield pd.DataFrame({"clip_id": [key[0]], "seq": [events[-1][0]], "word_indexes": [words]})


def stream_selections(events: DataFrame) -> DataFrame:
    """Current selection per clip from a stream of selection events.

    What an event does depends on all events before it in order of ``seq``, so the state
    holds the events of a clip and a late one is put in its place: after all have
    arrived, in any order, the selection is that of ``fold_events``. Events that are
    delivered again are skipped.
    """
    return events.groupBy("clip_id").applyInPandasWithState(
        _update,
        "clip_id string, seq bigint, word_indexes array<int>",
        "seqs array<bigint>, ops array<string>, starts array<int>, stops array<int>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def stream_candidates(
    annotations: DataFrame, screenshots: DataFrame, out: str, limits: Limits = DEFAULT
):
    """Writer that extracts the candidates of each arriving batch of OCR results.

    An image arrives whole, so the batch job runs unchanged on each micro-batch. Each
    batch writes to its own folder: a repeated batch replaces its first try.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        layout = extract_layout(screenshots, ocr_words(batch), ocr_texts(batch), limits)
        layout.candidates.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return annotations.writeStream.foreachBatch(write)
