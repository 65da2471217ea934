"""Schemas of the records that the engine reads and writes."""

from __future__ import annotations

INSTANCE = (
    "repo string, instance_id string, base_commit string, patch string, test_patch string, problem_statement string, hints_text string, created_at string, version string, "
    "FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>, environment_setup_commit string, workload string, speedup double, covering_tests array<string>, notes string, single_thread_tests array<string>"
)
PREDICTION = "instance_id string, model_patch string, model_name_or_path string"
PULL = (
    "number long, title string, body string, merged_at string, created_at string, url string, labels array<struct<name:string>>, "
    "base struct<sha:string,repo:struct<full_name:string>>, resolved_issues array<string>"
)
TRAJECTORY = (
    "instance_id string, history array<struct<action:string,source:string>>, metadata struct<eval_output_dir:string>, "
    "test_result struct<git_patch:string>, metrics struct<accumulated_cost:double,accumulated_token_usage:map<string,long>>"
)
EVAL_REPORT = (
    "instance_id string, raw_pred_speedup_ratio double, pred_speedup_ratio double, gold_speedup_ratio double, human_speedup_ratio double, "
    "correctness double, correctness_pct double, pre_edit_runtime double, patch_length int"
)
PROFILE_NODE = "path string, file string, line int, func string, ncalls long, tottime double, cumtime double"
PROFILE_EDGE = "path string, caller string, callee string, calls long, tottime double, cumtime double"
