"""Request limiting and the audit digest, for batches of requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fixed_window(requests: DataFrame, client: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """``requests`` plus ``allowed``: the first ``limit`` requests of a client in each aligned window.

    Partitions are (client, window), so a busy client is spread over its windows.
    """
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    w = Window.partitionBy(client, "window_no").orderBy(ts, *[c for c in requests.columns if c not in (client, ts)][:1])
    return requests.withColumn("window_no", slot).withColumn("allowed", F.row_number().over(w) <= limit)


def _anchored(limit: int, seconds: int):
    width = seconds * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by client and time; the open window of the last client is carried from batch to batch."""
        client, state = None, None
        for pdf in batches:
            clients, times = pdf.iloc[:, 0].to_numpy(), pdf.iloc[:, 1].to_numpy()
            edges = [0, *(np.flatnonzero(clients[1:] != clients[:-1]) + 1), len(pdf)] if len(pdf) else []
            done = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if state is None or clients[lo] != client:
                    if state is not None:
                        done.append((client, *state[2:]))
                    client, state = clients[lo], [None, 0, 0, 0, 0]
                at = lo
                while at < hi:
                    if state[0] is None or times[at] - state[0] >= width:
                        state[0], state[1] = times[at], 0
                        state[4] += 1
                    end = lo + int(np.searchsorted(times[lo:hi], state[0] + width))
                    taken = end - at
                    state[3] += max(0, min(limit - state[1], taken))
                    state[1], state[2], at = state[1] + taken, state[2] + taken, end
            if done:
                yield pd.DataFrame(done, columns=[pdf.columns[0], "n_requests", "n_allowed", "n_windows"])
        if state is not None:
            yield pd.DataFrame([(client, *state[2:])], columns=[pdf.columns[0], "n_requests", "n_allowed", "n_windows"])

    return fold


def anchored_window(requests: DataFrame, client: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """(client, n_requests, n_allowed, n_windows): a window opens with the first request after the previous one closed.

    The state follows the order of a client's requests, so these stay in one task, but as a sorted stream of batches of
    which only the open window is kept; a busy client is never collected. Null times and clients are left out.
    """
    rows = requests.where(F.col(ts).isNotNull() & F.col(client).isNotNull()).select(client, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    kind = rows.schema[client].dataType.simpleString()
    sorted_rows = rows.repartition(client).sortWithinPartitions(client, "t")
    return sorted_rows.mapInPandas(_anchored(limit, seconds), f"{client} {kind}, n_requests int, n_allowed int, n_windows int")


def audit_digest(df: DataFrame, name: str, pepper: str) -> DataFrame:
    """``df`` with the name replaced by its peppered digest: no personal data is kept."""
    return df.withColumn("name_digest", F.sha2(F.concat(F.lit(pepper), F.lit(" "), F.lower(name)), 256)).drop(name)
