"""Commit history: incremental sync, date reports, sprints and their reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Commits

#: Sprints up to which the range join sends them to every executor.
BROADCAST_SPRINTS = 10_000


def new_commits(walked: DataFrame, known: DataFrame, cap: int = Commits.max_per_sync, position: str = "position") -> DataFrame:
    """The newest commits before the first one that is stored already, at most
    ``cap`` per repository. ``walked`` is ordered by ``position``, newest first.
    The first known position is an aggregate; the window sees what is before it,
    and ``cap`` rows of a repository from each partition."""
    keys = ["repository_id", "commit_hash"]
    first = walked.join(known.select(*keys), keys, "left_semi").groupBy("repository_id").agg(F.min(position).alias("_first"))
    new = walked.join(first, "repository_id", "left").filter(F.col("_first").isNull() | (F.col(position) < F.col("_first")))
    w = Window.partitionBy("repository_id").orderBy(position)
    return new.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).select(*walked.columns)


def diff_stats(edits: DataFrame) -> DataFrame:
    """files_changed, insertions, deletions per commit against its first
    parent; merges count nothing. ``edits``: repository_id, commit_hash,
    n_parents, file, insertions, deletions."""
    merge = F.col("n_parents") > 1
    own = edits.groupBy("repository_id", "commit_hash", "n_parents").agg(F.countDistinct("file").alias("f"), F.sum("insertions").alias("i"), F.sum("deletions").alias("d"))
    pick = lambda c: F.when(merge, 0).otherwise(F.coalesce(c, F.lit(0))).cast("int")
    return own.select("repository_id", "commit_hash", pick(F.col("f")).alias("files_changed"), pick(F.col("i")).alias("insertions"), pick(F.col("d")).alias("deletions"))


def between_days(at: Column, first: Column | date, last: Column | date | None = None) -> Column:
    """first day 00:00 up to the end of the last day; one day if it is null."""
    first = first if isinstance(first, Column) else F.lit(first)
    last = first if last is None else last if isinstance(last, Column) else F.lit(last)
    return (at >= first.cast("timestamp_ntz")) & (at < F.date_add(last, 1).cast("timestamp_ntz"))


def in_range(commits: DataFrame, first: date, last: date | None = None, repository_id: str | None = None) -> DataFrame:
    if first is None:
        raise ValueError("a report needs a first day")
    if last is not None and last < first:
        raise ValueError("the last day is before the first")
    found = commits.filter(between_days(F.col("commit_date"), first, last))
    return found.filter(F.col("repository_id") == repository_id) if repository_id and str(repository_id).strip() else found


def author_breakdown(commits: DataFrame) -> DataFrame:
    """author_name, author_email, n_commits; ties by name and address."""
    return commits.groupBy("author_name", "author_email").agg(F.count("*").alias("n_commits")).orderBy(F.desc("n_commits"), "author_name", "author_email")


def date_report(commits: DataFrame, first: date, last: date | None = None, repository_id: str | None = None) -> DataFrame:
    """One row: totals, authors by count, commits newest first."""
    own = in_range(commits, first, last, repository_id)
    by = own.groupBy("author_name", "author_email").agg(F.count("*").alias("n"))
    authors = by.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "author_name", "author_email", "n"))).alias("authors"))
    return authors.select(F.lit(first).alias("first_day"), F.lit(last or first).alias("last_day"), F.coalesce("total", F.lit(0)).alias("total"), F.transform("authors", lambda a: F.struct(a["author_name"], a["author_email"], a["n"])).alias("authors"))


def commit_listing(commits: DataFrame) -> DataFrame:
    return commits.orderBy(F.desc("commit_date"), "commit_hash").select("commit_hash", F.substring("commit_hash", 1, 8).alias("short_hash"), "author_name", "author_email", "commit_date", "short_message", "branch", "files_changed", "insertions", "deletions")


def generate_sprints(spark: SparkSession, start: date, count: int, length_days: int = Commits.sprint_length_days, prefix: str = "Sprint", repository_id: str | None = None) -> DataFrame:
    """``count`` consecutive inclusive ranges."""
    if start is None or count < 1 or length_days < 1:
        raise ValueError("sprints need a start, a count and a length of at least one day")
    n = spark.range(count).select(F.col("id").cast("int").alias("n"))
    first = F.date_add(F.lit(start), F.col("n") * length_days)
    return n.select((F.col("n") + 1).cast("string").alias("id"), F.concat(F.lit(prefix + " "), F.col("n") + 1).alias("name"), first.alias("start_date"), F.date_add(first, length_days - 1).alias("end_date"), F.lit(repository_id).cast("string").alias("repository_id"))


def sprints_over(commits: DataFrame, length_days: int = Commits.sprint_length_days, prefix: str = "Sprint") -> DataFrame:
    """Consecutive sprints from the day of the first commit to that of the last."""
    if length_days < 1:
        raise ValueError("sprints need a length of at least one day")
    days = commits.agg(F.to_date(F.min("commit_date")).alias("first"), F.to_date(F.max("commit_date")).alias("last")).filter("first is not null")
    n = days.select("first", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("last", "first") / length_days).cast("int"))).alias("n"))
    start = F.date_add("first", F.col("n") * length_days)
    return n.select((F.col("n") + 1).cast("string").alias("id"), F.concat(F.lit(prefix + " "), F.col("n") + 1).alias("name"), start.alias("start_date"), F.date_add(start, length_days - 1).alias("end_date"), F.lit(None).cast("string").alias("repository_id"))


def check_sprint(name: str, start: date, end: date) -> None:
    if not name or not name.strip():
        raise ValueError("a sprint needs a name")
    if start is None or end is None or end < start:
        raise ValueError("a sprint needs a start and an end that is not before it")


def sprint_commits(sprints: DataFrame, commits: DataFrame, override: str | None = None) -> DataFrame:
    """Range join of sprints and commits by day: a sprint's own repository,
    else the override, limits it; blank means all. Days are the equi-key, so
    neither side has to be small and no pair outside its days is formed."""
    scope = F.coalesce("repository_id", F.lit(override).cast("string"))
    days = sprints.withColumn("_scope", F.when(F.trim(scope) != "", scope)).withColumn("_day", F.explode(F.sequence("start_date", "end_date"))).select(F.col("id").alias("sprint_id"), "_scope", "_day")
    own = commits.withColumn("_day", F.to_date("commit_date")).join(days, "_day").filter(F.col("_scope").isNull() | (F.col("_scope") == F.col("repository_id")))
    return own.drop("_day", "_scope")


def sprint_report(sprints: DataFrame, commits: DataFrame, override: str | None = None) -> DataFrame:
    """Every sprint with its totals and authors; one without commits stays."""
    by = sprint_commits(sprints, commits, override).groupBy("sprint_id", "author_name", "author_email").agg(F.count("*").alias("n"))
    own = by.groupBy("sprint_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "author_name", "author_email", "n"))).alias("_a"))
    out = sprints.join(own, sprints.id == own.sprint_id, "left").drop("sprint_id")
    none = F.array().cast("array<struct<author_name:string,author_email:string,n:bigint>>")
    return out.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("authors", F.coalesce(F.transform("_a", lambda a: F.struct(a["author_name"], a["author_email"], a["n"])), none)).drop("_a")


def commit_text(repository: Column) -> Column:
    """Text that a commit is retrieved by; columns of a commit row."""
    message = F.when(F.trim(F.coalesce("full_message", F.lit(""))) != "", F.col("full_message")).otherwise(F.col("short_message"))
    return F.format_string("Repository: %s\nBranch: %s\nCommit: %s\nAuthor: %s <%s>\nDate: %s\nMessage: %s\nFiles changed: %d (+%d / -%d)", repository, "branch", F.substring("commit_hash", 1, 8), "author_name", "author_email", F.date_format("commit_date", "yyyy-MM-dd'T'HH:mm:ss"), message, "files_changed", "insertions", "deletions")


def truncated(c: Column, chars: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, chars)


def repository_name(url: Column) -> Column:
    """owner/name from a clone address."""
    clean = F.regexp_replace(F.regexp_replace(url, r"\.git$", ""), "/+$", "")
    parts = F.split(clean, "[/:]")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(clean)


def wall_clock(instant: Column, zone: Column) -> Column:
    """A UTC instant as the committer's local time, without a zone."""
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def sync_states(runs: DataFrame) -> DataFrame:
    """repository_id, n, status: what each run goes through. A repository that
    was never synced is CLONING, another SYNCING; then it is READY or FAILED."""
    begun = F.when(F.col("previous").isNull(), "CLONING").otherwise("SYNCING")
    ended = F.when(F.col("error").isNotNull(), "FAILED").otherwise("READY")
    return runs.select("repository_id", F.posexplode(F.array(begun, ended)).alias("n", "status"))


def sync_status(runs: DataFrame) -> DataFrame:
    """READY or FAILED with counts and the newest hash, from one row per run:
    repository_id, error, n_new, n_before, newest, previous."""
    failed = F.col("error").isNotNull()
    return runs.select("repository_id", F.when(failed, "FAILED").otherwise("READY").alias("status"), (F.col("n_before") + F.when(failed, 0).otherwise(F.col("n_new"))).alias("total_commits"), F.when(failed, F.col("previous")).otherwise(F.coalesce("newest", "previous")).alias("last_hash"), F.col("error").alias("last_error"))
