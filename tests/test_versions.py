import pytest
from conftest import rows

from pulsewatch.plans.tables import rule_rows
from pulsewatch.sources import versions
from pulsewatch.sources.versions import RuleVersions


def rule(limit, name="r"):
    return {"rule_id": name, "resource": "s", "metric": "m", "op": ">", "threshold": limit}


@pytest.fixture
def log(spark, tmp_path):
    now = {"rules": [rule(1.0)]}
    return RuleVersions(spark, str(tmp_path), lambda: rule_rows(spark, now["rules"])), now


def limits(df):
    return rows(df, "rule_id", "threshold")


def test_a_batch_keeps_its_rules(log):
    found, now = log
    assert limits(found.of("a").of_batch(0)) == [("r", 1.0)]
    now["rules"] = [rule(2.0), rule(3.0, "more")]
    assert limits(found.of("a").of_batch(0)) == [("r", 1.0)]
    assert limits(found.of("a").of_batch(1)) == [("more", 3.0), ("r", 2.0)]
    assert limits(found.of("b").of_batch(0)) == [("more", 3.0), ("r", 2.0)]
    assert limits(found.of("a")()) == [("more", 3.0), ("r", 2.0)]


def test_versions_are_shared_and_written_once(log, spark, tmp_path):
    found, now = log
    names = {found.pin(q, n) for q in ("a", "b") for n in range(3)}
    assert len(names) == 1 and len(list((tmp_path / "versions").iterdir())) == 1
    now["rules"] = []
    assert found.pin("a", 9) not in names and limits(found.of("a").of_batch(9)) == []
    other = RuleVersions(spark, str(tmp_path), lambda: rule_rows(spark, [rule(7.0)]))
    assert other.pin("a", 0) in names, "a restarted process finds what the first one logged"


def test_half_written_entries_do_not_count(log, tmp_path):
    found, _ = log
    (tmp_path / "making").mkdir()
    (tmp_path / "making" / "left").write_text("{")
    assert found.pinned("a", 0) is None
    assert found.pin("a", 0) == found.pinned("a", 0)


def test_cleaning_keeps_what_batches_name(log, tmp_path):
    found, now = log
    for n in range(5):
        now["rules"] = [rule(float(n))]
        found.pin("a", n)
    found.clean(keep_batches=2)
    assert len(list((tmp_path / "versions").iterdir())) == 5, "young versions stay"
    found.clean(keep_batches=2, least_age=-versions.LEAST_AGE)
    assert len(list((tmp_path / "versions").iterdir())) == 2
    assert limits(found.of("a").of_batch(3)) == [("r", 3.0)]
