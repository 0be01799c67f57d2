"""Poll records of recognition jobs: latest state, progress, outcome.

``max_by`` keeps one row a job before the exchange, so a job with very many polls gathers nowhere.  Defined results: unknown states
are ``other``; states compare in lower case; a job without any poll time takes its highest poll id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: states of the services
STATES = {"pending": "waiting", "waiting-file": "waiting", "running": "running", "converting": "running", "done": "done", "failed": "failed"}


def state_of(state):
    plain = F.lower(F.trim(state))
    out = F.lit("other")
    for name, kind in STATES.items():
        out = F.when(plain == name, F.lit(kind)).otherwise(out)
    return F.when(state.isNull(), F.lit("other")).otherwise(out)


def latest_polls(df: DataFrame) -> DataFrame:
    """(job_id, polls, state, pages, last_poll) of each job by its last poll."""
    last = F.max_by(F.struct("job_state", "total_pages", "extracted_pages", "poll_id"), F.struct("polled_at", "poll_id"))
    grouped = df.groupBy("job_id").agg(F.count("*").alias("polls"), last.alias("x"))
    share = F.when(F.col("x.total_pages") > 0, F.coalesce(F.col("x.extracted_pages"), F.lit(0)) / F.col("x.total_pages"))
    return grouped.select("job_id", "polls", state_of(F.col("x.job_state")).alias("state"), F.col("x.total_pages").alias("total_pages"), share.alias("progress"), F.col("x.poll_id").alias("last_poll"))
