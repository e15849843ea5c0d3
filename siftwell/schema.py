"""Schemas of the engine's tables, and checks of what is handed in."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

CHUNKS = "chunk_id string, text string, source string, type string, category string, workbook string, sheet string, sheet_type string, row_start int, row_end int, fields map<string,string>, embedding array<float>"
DOCUMENTS = "id string, name string, type string, source string, chunk_count int, ingested_at timestamp_ntz"
MESSAGES = "id string, session_id string, role string, content string, interaction_id string, sources array<string>, created_at timestamp_ntz"
FEEDBACK = "interaction_id string, session_id string, question string, answer string, rating string, comment string, sources array<string>, created_at timestamp_ntz"
BATCHES = "id string, folder_path string, total_files int, success_count int, failure_count int, status string, started_at timestamp_ntz, completed_at timestamp_ntz"
SUCCESSES = "batch_id string, file_name string, file_path string, document_record_id string, chunk_count int, completed_at timestamp_ntz"
FAILURES = "batch_id string, file_name string, file_path string, error_message string, failed_at timestamp_ntz"
REPOSITORIES = "id string, repo_url string, name string, branch string, local_path string, status string, total_commits int, last_synced_commit_hash string, last_synced_at timestamp_ntz, last_error string, created_at timestamp_ntz"
COMMITS = "repository_id string, commit_hash string, author_name string, author_email string, commit_date timestamp_ntz, short_message string, full_message string, branch string, files_changed int, insertions int, deletions int, ingested_at timestamp_ntz"
SPRINTS = "id string, name string, start_date date, end_date date, repository_id string, created_at timestamp_ntz"
VOTE_COUNTS = "source string, up bigint, down bigint"
CELLS = "workbook string, sheet string, row int, col int, kind string, raw string"

# Metadata keys with a column of their own.
STRUCTURAL_KEYS = ("source", "type", "category", "workbook", "sheet", "sheetType", "rowStart", "rowEnd")


#: Columns that hold secrets, which no listing shows.
SECRETS = ("credentials", "password", "secret", "token", "access_token", "api_key")


def shown(df: DataFrame) -> DataFrame:
    """``df`` without columns that hold secrets, by their names in any case."""
    return df.drop(*[c for c in df.columns if c.lower() in SECRETS])


def require(df: DataFrame, *columns: str) -> None:
    """The catalog check of a table: every column has to be there."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"no column {', '.join(lacking)} among {', '.join(df.columns)}")


def safe_name(name: str) -> str:
    """A name that may go into SQL text, or an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name
