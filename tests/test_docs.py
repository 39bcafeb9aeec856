"""COVERAGE.md stays in step with the registry."""

import os
import re

from conftest import ROOT

from logweave.plans import all_queries


def test_coverage_lists_every_query():
    text = open(os.path.join(ROOT, "COVERAGE.md")).read()
    queries = set(all_queries())
    named = set(re.findall(r"`([a-z]\d+_[a-z0-9_]+)`", text))
    assert queries - named == set(), "registered but not in COVERAGE.md"
    assert named - queries == set(), "in COVERAGE.md but not registered"
