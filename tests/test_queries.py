"""Registered queries next to their SQL at sf0.001, and repository rules. TALLYMARK_ALL=1 runs every query."""
import os
import pathlib
import re

import pytest

import __spark_entry__ as entry
from tests import oracle_check

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parents[1]
SAMPLE = ("S1_read_jsonl_problems", "S3_adapt_source", "V6_validate_distribution", "V8_partition_size_report", "D5_drop_exact_duplicates", "D8_exclude_states", "P10_grouped_folds", "P5_alternate_pairs", "A2_date_facts", "A4_augment_options",
          "R5_eval_rule", "M8_metrics_by_task", "M16_order_stability", "M28_failure_packet", "C2_temperature_by_group", "C12_join_predictions", "L9_screen", "B7_observation_lines", "B11_structural_features", "B19_audit_state_chain", "B24_retry_chains", "U5_json_leaves")


def names():
    return sorted(entry.queries()) if os.environ.get("TALLYMARK_ALL") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, name):
    con = oracle_check.connect(SF)
    ok, note = oracle_check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_inventory_entry_has_a_query():
    have = {n.split("_")[0] for n in entry.queries()}
    want = {f"{f}{i}" for f, k in (("S", 10), ("V", 15), ("D", 12), ("P", 14), ("A", 14), ("R", 9), ("M", 30), ("C", 14), ("L", 14), ("B", 28), ("W", 7), ("U", 5)) for i in range(1, k + 1)}
    assert want <= have, sorted(want - have)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_code_avoids_unsafe_actions():
    for p in (ROOT / "tallymark").rglob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and not re.search(r"\.rand\(|F\.rand|toPandas\(\)", text), p
