"""All dealt operators and the pipeline, on workers that cannot import the package."""

from pulsewatch.llm import catalog
from tests.test_workers import run_elsewhere


def test_operators_run_on_workers_without_the_package(tmp_path):
    names = [*catalog.QUERIES, "pipeline"]
    assert set(run_elsewhere(names, str(tmp_path))) == set(names)
