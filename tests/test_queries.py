"""Every registered query of the engine against its SQL, and the driver's contract."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from posmv.plans import catalogue
from tests import oracle

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    oracle.check(con, catalogue.ORACLE_SQL[name], catalogue.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_without_sql(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_folder(tmp_path):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=here, capture_output=True, text=True, check=True).stdout
    assert said.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE_SQL))]
