"""The scoring job on a batch table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.operators.alerts import ALERTS_PER_BATCH, anomalies, first_alerts
from strayrow.operators.features import assemble
from strayrow.operators.forest import score


def score_table(
    records: DataFrame,
    model: RandomForestClassificationModel,
    columns: Sequence[str],
    vote: str = "soft",
    handle_invalid: str = "error",
) -> DataFrame:
    """Records with their feature vector and prediction: 0 marks an anomaly."""
    return score(assemble(records, columns, handle_invalid=handle_invalid), model, vote)


def alert_records(
    records: DataFrame,
    model: RandomForestClassificationModel,
    columns: Sequence[str],
    order: Sequence[str],
    limit: int = ALERTS_PER_BATCH,
) -> DataFrame:
    """The first anomalies of a table, as alert records."""
    return first_alerts(anomalies(score_table(records, model, columns)), order, limit)


#: Up to so many sites are broadcast, which lets Spark skip the other sites' directories.
MAX_BROADCAST_SITES = 100_000


def score_sites(
    landed: DataFrame,
    sites: DataFrame,
    model: RandomForestClassificationModel,
    columns: Sequence[str],
    vote: str = "soft",
    handle_invalid: str = "error",
) -> DataFrame:
    """Score the records of the given sites (column ``site``) with the model all sites share.

    ``landed`` is a scan of a ``date=/site=`` tree. The sites are a table, whatever query it comes from:
    the directories of other sites are pruned when the job runs, not read and dropped.
    """
    # Spark prunes by a table only if it is filtered by some comparison; this one leaves out null sites.
    wanted = sites.select("site").where(F.length("site") >= 0).distinct()
    if wanted.count() <= MAX_BROADCAST_SITES:
        wanted = F.broadcast(wanted)
    return score_table(landed.join(wanted, "site"), model, columns, vote, handle_invalid)
