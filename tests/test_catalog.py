"""Named queries against their SQL on the smallest tables.

A spread over all modules by default; ``ALL_QUERIES=1`` runs every one. ``python tests/oracle.py``
does the same from the command line.
"""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from oracle import difference, duck
from tidemark.catalog import CATALOG

SF = "/root/testdata/sf0.001"
SPREAD = (
    "a2_kline_files", "a7_verify_then_trim", "a9_candle_upsert", "b6_normalised_instruments", "c4_reference_merge", "c6_last_n_bars", "d3_violation_counts",
    "d13_trade_metrics", "e6_macd", "e10_zero_volume_streaks", "e12_missing_runs", "e17_funding", "f1_event_order", "h2_content_hash", "i2_evaluate_orders",
    "i2_resting_orders", "i4_order_states", "j2_latest_open_bar", "j3_stream_from_store", "j6_gate_from_store", "j7_stream_events", "k1_events", "k4_backtest_tearsheet",
    "k4_two_symbols", "k6_stateful_rule", "h2_version_diff", "h2_changed_rows", "b10_latency_sketches", "l3_orphans", "l_audit_all",
)


@pytest.mark.parametrize("name", sorted(CATALOG) if os.environ.get("ALL_QUERIES") else SPREAD)
def test_query_matches_sql(spark, name):
    entry = CATALOG[name]
    df = entry.run(spark, SF)
    if entry.sql is None:
        assert df.count() > 0
    else:
        assert difference(df, duck(SF), entry.sql) is None


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_everything_else_works_without_the_text_operators(tmp_path):
    """A copy of the repository without the operators for training text still names its queries."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q)"
    told = [subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""}).stdout]
    (tmp_path / "corpus_pipeline.py").write_text("from tidemark.llm import text  # left behind")
    told.append(subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""}).stdout)
    assert told[0] == told[1] == f"{len(CATALOG)} {sum(e.sql is not None for e in CATALOG.values())} False\n"
