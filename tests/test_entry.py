"""The entry module: every query has a function, every SQL a query, and small tables give what SQL gives."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from compare import rows

DATA = Path("/root/testdata/sf0.001")
SOME = ["keyword_half_year", "keyword_oa_domain", "keyword_sets", "mle_half_year", "mle_profile_ci", "domain_majority", "oa_definitions", "usage_items", "usage_list_category", "detector_smooth", "spearman", "ols_grid", "policy_vote", "monthly_sample", "fulltext_oa"]


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    got = e.queries()[name](spark, str(DATA))
    want = db.execute(e.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_without_the_optional_part(monkeypatch):
    monkeypatch.setattr(e, "OPTIONAL", {"lexitide.absent": "lexitide.absent.queries"})
    assert "p7_found" in e.queries() and "p1_found" not in e.queries()


def test_an_empty_folder_is_no_part(tmp_path, monkeypatch):
    (tmp_path / "leftover").mkdir()
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(e, "OPTIONAL", {"leftover": "leftover.queries"})
    assert "p7_found" in e.queries()
    (tmp_path / "leftover" / "queries.py").write_text("import no_such_package")
    with pytest.raises(ModuleNotFoundError, match="no_such_package"):
        e.queries()
