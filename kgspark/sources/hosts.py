"""Landed code-host activity (pull requests, issues, commits) as one record shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.sources.normalize import fold_comments

TICKET = (
    "repo string, number long, title string, body string, user struct<login: string>, created_at string, updated_at string, "
    "merged_at string, closed_at string, state string, pull_request struct<url: string>"
)
COMMIT = "repo string, sha string, commit struct<message: string, author: struct<name: string, date: string>>"

DISCUSSION = (
    "repo string, number long, title string, body string, author struct<login: string>, createdAt string, "
    "comments array<struct<author: struct<login: string>, createdAt: string, body: string>>"
)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _tickets(rows: DataFrame, kind: str) -> DataFrame:
    names = ["title", "body", "created_at", "updated_at", "merged_at", "closed_at", "state"]
    return rows.select(
        F.lit(kind).alias("kind"), "repo", F.concat("repo", F.lit("#"), F.col("number").cast("string")).alias("id"), "number",
        *[_text(n).alias(n) for n in names], _text("user.login").alias("author"),
    )


def activity_records(pulls: DataFrame, issues: DataFrame, commits: DataFrame) -> DataFrame:
    """One row for each pull request and issue (schema TICKET) and commit (schema COMMIT); issue rows that are pull requests are left out.

    A commit's title is its message's first line. Missing texts are empty; commits have no number. Repeated rows stay.
    """
    body = _text("commit.message")
    made = commits.select(
        F.lit("commit").alias("kind"), "repo", _text("sha").alias("id"), F.split(body, r"\r\n|\r|\n")[0].alias("title"), body.alias("body"),
        _text("commit.author.name").alias("author"), _text("commit.author.date").alias("created_at"),
        *[F.lit("").alias(n) for n in ("updated_at", "merged_at", "closed_at", "state")],
    )
    tickets = _tickets(pulls, "pull").unionByName(_tickets(issues.where("pull_request is null"), "issue"))
    return tickets.unionByName(made, allowMissingColumns=True)


def discussion_records(discussions: DataFrame) -> DataFrame:
    """One row for each discussion (schema DISCUSSION) in the shape of activity_records; replies are folded into the body."""
    replies = F.transform("comments", lambda c: F.struct(c["author"]["login"].alias("author"), c["body"].alias("body")))
    return discussions.select(
        F.lit("discussion").alias("kind"), "repo", F.concat("repo", F.lit("#discussion-"), F.col("number").cast("string")).alias("id"), "number",
        _text("title").alias("title"), fold_comments(F.col("body"), replies, "Replies:", author=True).alias("body"), _text("createdAt").alias("created_at"),
        *[F.lit("").alias(n) for n in ("updated_at", "merged_at", "closed_at", "state")], _text("author.login").alias("author"),
    )


def with_comments(tickets: DataFrame, comments: DataFrame) -> DataFrame:
    """tickets (id, body ..) with their comments (id, created_at, body) folded into the body, in order of time."""
    held = comments.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "body"))), lambda c: c["body"]).alias("folded"))
    out = tickets.hint("merge").join(held, "id", "left").withColumn("body", fold_comments(F.col("body"), F.col("folded")))
    return out.select(*tickets.columns)
