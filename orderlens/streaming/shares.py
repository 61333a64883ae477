"""ST3: proportional-share refresh when order values change, per micro-batch.

Each micro-batch of value changes is joined to the current share table; the recomputed
shares of the touched orders are written under the batch id with the time and version of
their change.  ``current_shares`` resolves the newest change per share over all epochs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators.sharing import share_value
from orderlens.streaming.sink import write_epochs


def refresh_batch(changes: DataFrame, shares: DataFrame) -> DataFrame:
    """Shares of the changed orders with value = new total * pct / 100 (latest change per
    order), and that change's ``ts`` and ``versao``."""
    latest = (changes.groupBy("id_pedido")
              .agg(F.max(F.struct("ts", "versao", "valor_total")).alias("_novo")))
    return (shares.join(latest, "id_pedido")
            .withColumn("valor_rateado", share_value(F.col("_novo.valor_total"), F.col("percentual_rateio")))
            .withColumn("ts", F.col("_novo.ts")).withColumn("versao", F.col("_novo.versao")).drop("_novo"))


def start_share_refresh(changes_stream: DataFrame, shares: DataFrame | Callable[[], DataFrame], out_path: str, checkpoint: str,
                        available_now: bool = True):
    """Run ST3: the refreshed shares of each micro-batch go to ``out_path``.  ``shares`` may be a function that
    reads the share table; it is called for each batch, so that the batch sees the table's current version."""
    table = shares if callable(shares) else lambda: shares
    return write_epochs(changes_stream, out_path, checkpoint, lambda batch: refresh_batch(batch, table()), available_now)


def newest_shares(refreshed: DataFrame) -> DataFrame:
    """The newest row (by ts, versao) of each refreshed share, in all its columns: the merge that ``compact_epochs`` takes."""
    keys = ["id_pedido", "id_cliente"]
    cols = [c for c in refreshed.columns if c != "epoch"]
    rest = [c for c in cols if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("ts", "versao")).alias("_s")
    return refreshed.groupBy(*keys).agg(newest).select(*keys, "_s.*").select(*cols)


def current_shares(refreshed: DataFrame) -> DataFrame:
    """One row per refreshed share: the one of the newest (ts, versao)."""
    return newest_shares(refreshed).drop("ts", "versao")
