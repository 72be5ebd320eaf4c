"""Spark schemas of the history model. Keys are logical; writers keep them unique."""

from __future__ import annotations

COMMENT = "struct<author:string,user:string,path:string,line:int,body:string,created_at:string>"

SCHEMAS = {
    "commit": "repo_id string, sha string, author_name string, author_email string, authored_date timestamp, message string, files_changed array<string>, symbols_modified array<string>, insertions int, deletions int, is_revert boolean, reverts_sha string, superseded_by_sha string, diff_summary string, raw_diff_truncated string",
    "pull_request": f"repo_id string, number int, title string, body string, state string, author string, created_at timestamp, merged_at timestamp, merge_commit_sha string, linked_issue_numbers array<int>, linked_commit_shas array<string>, review_comments array<{COMMENT}>, comments array<{COMMENT}>",
    "issue": f"repo_id string, number int, title string, body string, state string, author string, close_reason string, labels array<string>, created_at timestamp, closed_at timestamp, linked_pr_numbers array<int>, linked_commit_shas array<string>, comments array<{COMMENT}>",
    "chunk": "id string, repo_id string, source_type string, source_id string, text string, timestamp timestamp, file_paths array<string>, symbols_modified array<string>, related_ids array<string>, is_reverted boolean, token_count int, embedded boolean",
    "vector": "id string, embedding array<float>",
    "symbol_index": "repo_id string, symbol_id string, file_path string, symbol_name string, kind string, commit_count int",
    "causal_edges": "repo_id string, source_id string, target_id string, edge_type string, label string, highlight boolean",
    "repo_meta": "repo_id string, repo_name string, repo_url string, embedder_provider string, embedder_model string, embedder_dimension int, last_ingested_at timestamp, key string, value string, created_at timestamp, updated_at timestamp",
}

KEYS = {"commit": ["repo_id", "sha"], "pull_request": ["repo_id", "number"], "issue": ["repo_id", "number"], "chunk": ["id"], "symbol_index": ["repo_id", "symbol_id"], "causal_edges": ["repo_id", "source_id", "target_id", "edge_type"], "repo_meta": ["repo_id"]}


def empty(spark, name: str):
    return spark.createDataFrame([], SCHEMAS[name])
