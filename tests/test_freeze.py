import pytest
from tracewake.operators import freeze


def test_documents(spark):
    ranked = spark.createDataFrame([(1, "a", 11, "s1"), (2, "b", 12, "s2"), (3, "c", 13, "s3")], "eligible_rank int, path string, version_id long, sha256 string")
    lines = spark.createDataFrame([(11, 1, "structural", "e1", "x"), (11, 2, "fusion", "e2", "rank 1"), (12, 1, "lexical", "e3", "y")], "version_id long, ordinal int, type string, id string, sentence string")
    ranking = freeze.ranking_document(ranked, "case", 2)
    package = freeze.evidence_package(ranking, lines)
    packet = freeze.review_packet(package, "salt")
    assert {c["path"] for c in packet["candidates"]} == {"a", "b"} and "rank" not in str(packet)
    assert freeze.reconcile_packet(packet, ranking) == []
    assert freeze.reconcile_packet(packet, freeze.ranking_document(ranked, "case")) == ["c: missing"]
    with pytest.raises(ValueError, match="13"):
        freeze.evidence_package(freeze.ranking_document(ranked, "case"), lines)
    filled = freeze.annotation_template(packet) | {"annotator_id": "x"}
    assert len(freeze.annotation_problems(filled, packet)) == 4
    for a in filled["annotations"]:
        a["reference_assessment"] |= {"classification": "likely_affected", "evidence_sufficiency": "fully_sufficient"}
    assert freeze.annotation_problems(filled, packet) == []
    filled["annotations"][0]["blinding_verification"]["reviewed_model_outputs"] = True
    assert len(freeze.annotation_problems(filled, packet)) == 1


def test_identity_and_gate():
    identity = freeze.bind_identity({"a": 1}, {"t": "d"}, {"id": "m"})
    assert freeze.identity_problems(identity, {"a": 1}, {"t": "d"}, {"id": "m"}) == []
    assert freeze.identity_problems(identity, {"a": 1}, {"t": "e"}, {"id": "m"}) == ["tables", "identity"]
    assert freeze.pin_problems({"id": "m", "dims": 3}, {"id": "m", "dims": 4}) == ["dims"]
    assert freeze.gate([], 2) == "RELEASED" and freeze.gate([], 1) == freeze.gate(["x"], 3) == "BLOCKED"
