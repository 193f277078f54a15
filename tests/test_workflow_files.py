"""Files of agents' tasks and transcripts, and their scores."""

import json

import pytest

from corvane.operators import workflow
from corvane.sources import readers

CASE = {"id": "w1", "task": "Which rule holds?", "expected": {"final_citations": [{"doc_number": "1/2020", "article": "5"}, {"doc_number": "2/2020"}], "must_check_relations": True}, "scoring_notes": "x"}


def written(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("bad", [[], {}, [{"id": "", "task": "t"}], [{"id": "a"}], [CASE, CASE]])
def test_refused_sets(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        readers.workflow_cases(spark, written(tmp_path, "bad.json", bad))


def test_cases_and_transcripts_are_scored(spark, tmp_path):
    cases = readers.workflow_cases(spark, written(tmp_path, "cases.json", [CASE, {"id": "w2", "task": "None of it", "expected": {"expect_abstain": True}}]))
    done = [{"case_id": "w1", "cited": [{"doc_number": "1/2020", "article": "5"}], "tool_calls": [{"tool": "search", "args": {}}, {"tool": "document", "args": {"id": 1}}]}, {"case_id": "w2", "abstained": True}]
    got = {r.case_id: r for r in workflow.scored(cases, readers.transcripts(spark, written(tmp_path, "done.json", done))).collect()}
    assert got["w1"].citation_score == 0.5 and got["w1"].followed_relations and got["w1"].tool_calls == 2
    assert got["w2"].abstain_correct and got["w2"].citation_score == 1.0
