"""Find lines that recur excessively within one source and remove them from its texts.

A line recurs excessively if its normal form stands in at least ``LEAST_GROUPS`` different jobs and in at
least ``LEAST_SHARE`` of all jobs of its source.

1. One aggregate counts the jobs and long lines of each source, the latter before they are normalised: at least as many as count.
2. Mergeable heavy-hitter summaries (frequent-items sketches, Misra-Gries family) of hashed lines are built per
   source, map-side partial and then merged; what moves is one sketch per source and task, not the lines.  The
   number of counters follows from step 1, so that the largest possible error stays below half of the smallest
   count that matters in any source: no line is lost.  (The lines of a source that would take more counters than a sketch
   may have all go to step 3; the other sources keep their sketches.)
3. Lines among the candidates are kept in the checkpoint folder and counted exactly: distinct jobs per source and line.
4. Confirmed lines go back to them, broadcast if their checked number is small, else by a shuffle join.

Defined results: null or empty texts have no lines; null sources form one source; null jobs count as none; lines under
``LEAST_CHARS`` characters never count; a text left without lines is empty, not null; repeated rows
are cleaned each; other columns are kept by ``remove`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.runtime import broadcast_if_small, cut

LEAST_GROUPS, LEAST_SHARE, LEAST_CHARS = 4, 0.05, 20
#: a sketch with m counters is off by at most 3.5 / m of its input; it gives at most MOST_ITEMS items, of which a source with
#: MOST_COUNTERS counters has at most MOST_COUNTERS / 7 that matter
SKETCH_ERROR, MOST_COUNTERS, MOST_ITEMS = 3.5, 600_000, 100_000


def normal_form(line: Column) -> Column:
    """Lower case, digit runs as one digit, from the first letter or number to the last."""
    digits = F.regexp_replace(F.lower(line), r"\p{Nd}+", "0")
    return F.regexp_extract(digits, r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?", 0)


def is_long(line: Column) -> Column:
    """Whether a line has ``LEAST_CHARS`` characters besides the carriage return of its end."""
    return F.char_length(line) - F.endswith(line, F.lit("\r")).cast("int") >= LEAST_CHARS


def long_lines(df: DataFrame, key: Column, source: Column, job: Column, text: Column) -> DataFrame:
    """(row_id, source, job_id, line_no, norm) of the lines that can count."""
    lines = df.select(key.alias("row_id"), F.coalesce(source, F.lit("")).alias("source"), job.alias("job_id"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    # as the row of a generator the form is worked out once, not again in the filter and in the hash
    norm = F.explode(F.array(normal_form(F.col("line")))).alias("norm")
    return lines.where(is_long(F.col("line"))).select("row_id", "source", "job_id", (F.col("at") + 1).alias("line_no"), norm).where("norm <> ''")


def sources_of(df: DataFrame, source: Column, job: Column, text: Column) -> DataFrame:
    """(source, jobs, lines, least): the lines of every source that may count, and the jobs that an excessive one needs."""
    # null texts have none, whatever size() makes of null in this session
    long = F.greatest(F.size(F.filter(F.split(text, "\n"), lambda x: F.char_length(x) >= LEAST_CHARS)), F.lit(0))
    counted = df.select(F.coalesce(source, F.lit("")).alias("source"), job.alias("job_id"), long.alias("n"))
    counted = counted.groupBy("source").agg(F.count_distinct("job_id").alias("jobs"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    return counted.withColumn("least", F.greatest(F.lit(LEAST_GROUPS), F.ceil(F.col("jobs") * LEAST_SHARE)))


def candidates(lines: DataFrame, jobs: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(source, line_hash) of every line that may be excessive, and the sources for which a sketch cannot promise that."""
    hashed = lines.select("source", F.xxhash64("norm").alias("line_hash"))
    volume = jobs.where("lines > 0").withColumn("ratio", F.col("lines") / F.col("least"))
    volume = cut(volume.select("source", (F.col("ratio") <= MOST_COUNTERS / 2 / 2 / SKETCH_ERROR).alias("fits"), "ratio"))
    ratio = volume.where("fits").agg(F.max("ratio")).first()[0]
    beyond = broadcast_if_small(volume.where("NOT fits").select("source"))
    if ratio is None:
        return None if volume.where("NOT fits").limit(1).count() else hashed.limit(0), beyond
    counters = 1 << max(10, int(2 * SKETCH_ERROR * ratio).bit_length())
    fitting = hashed.join(broadcast_if_small(volume.where("fits").select("source")), "source", "left_semi")
    top = fitting.groupBy("source").agg(F.expr(f"approx_top_k(line_hash, {min(counters, MOST_ITEMS)}, {counters})").alias("top"))
    hits = top.select("source", F.explode("top").alias("hit")).select("source", F.col("hit.item").alias("line_hash"), F.col("hit.count").alias("n"))
    return hits.join(jobs, "source").where(F.col("n") >= F.col("least")).select("source", "line_hash"), beyond


def excessive(df: DataFrame, key: Column, source: Column, job: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(confirmed lines per source, their places in the texts)."""
    lines = long_lines(df, key, source, job, text)
    jobs = broadcast_if_small(cut(sources_of(df, source, job, text)))
    likely, beyond = candidates(lines, jobs)
    if likely is not None:
        likely = broadcast_if_small(cut(likely))
        sketched = lines.withColumn("line_hash", F.xxhash64("norm")).join(likely, ["source", "line_hash"], "left_semi").drop("line_hash")
        lines = sketched.unionByName(lines.join(beyond, "source", "left_semi")) if beyond.limit(1).count() else cut(sketched)
    confirmed = (
        lines.groupBy("source", "norm")
        .agg(F.count_distinct("job_id").alias("in_jobs"), F.count("*").alias("occurrences"))
        .join(jobs, "source")
        .where((F.col("in_jobs") >= LEAST_GROUPS) & (F.col("in_jobs") * 20 >= F.col("jobs")))
        .select("source", "norm", "in_jobs", "jobs", "occurrences")
    )
    confirmed = broadcast_if_small(cut(confirmed))
    return confirmed, lines.join(confirmed.select("source", "norm"), ["source", "norm"], "left_semi").select("row_id", "line_no")


def remove(df: DataFrame, source: str, text: str, confirmed: DataFrame, out: str = "clean_text") -> DataFrame:
    """``df`` with the confirmed lines of its source taken out of its texts."""
    per_source = confirmed.groupBy(F.col("source").alias("_source")).agg(F.collect_set("norm").alias("_lines"))
    keep = F.filter(F.split(F.col(text), "\n"), lambda x: ~is_long(x) | ~F.coalesce(F.array_contains("_lines", normal_form(x)), F.lit(False)))
    joined = df.join(F.broadcast(per_source) if confirmed.limit(200_001).count() <= 200_000 else per_source, F.coalesce(F.col(source), F.lit("")) == F.col("_source"), "left")
    return joined.withColumn(out, F.array_join(keep, "\n")).drop("_source", "_lines")
