import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert names and set(e.oracle_sql()) <= names
    df = e.entry(spark)
    assert df.columns == ["company", "role", "source_type", "risk_bucket", "sum_prob", "n_sent", "a_mij"] and df.limit(1).count() == 1


def test_nothing_outside_imports_the_training_subpackage():
    for p in (ROOT / "earshot").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                module = getattr(node, "module", None) or ""
                assert "earshot.llm" not in module and not any("earshot.llm" in a.name for a in getattr(node, "names", [])), p
