"""Frozen documents of an evaluation: rankings, evidence, blinded review, annotations, identity and the gate."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewake.operators.validate import CLASSIFICATIONS
from tracewake.sources.documents import canonical, digest

SUFFICIENCY = ("fully_sufficient", "partially_sufficient", "completely_inadequate")
BLINDING = ("reviewed_diffs_or_hindsight", "reviewed_other_annotator", "reviewed_model_outputs")


def ranking_document(ranked: DataFrame, case: str, limit: int = 20) -> dict:
    """The ``limit`` best candidates of a case (``eligible_rank, path, version_id, sha256``) as a document."""
    rows = ranked.orderBy("eligible_rank").limit(limit).collect()
    return {"case_id": case, "candidates": [{"rank": r["eligible_rank"], "path": r["path"], "version_id": r["version_id"], "content_sha256": r["sha256"]} for r in rows]}


def evidence_package(ranking: dict, evidence: DataFrame) -> dict:
    """The ranking's candidates with all their evidence; a candidate without any is an error."""
    wanted = [c["version_id"] for c in ranking["candidates"]]
    by: dict = {v: [] for v in wanted}
    for r in evidence.filter(F.col("version_id").isin(wanted)).orderBy("version_id", "ordinal").collect():
        by[r["version_id"]].append({"id": r["id"], "type": r["type"], "text": r["sentence"]})
    if bare := [v for v in wanted if not by[v]]:
        raise ValueError(f"no evidence for version {bare[0]}")
    return {"case_id": ranking["case_id"], "candidates": [c | {"evidence": by[c["version_id"]]} for c in ranking["candidates"]]}


def review_packet(package: dict, salt: str) -> dict:
    """What a blinded reviewer sees: candidates in an order that tells nothing, without ranks, scores and fusion evidence."""
    order = lambda c: hashlib.sha256(f"{salt}:{package['case_id']}:{c['path']}".encode()).hexdigest()
    seen = [{"path": c["path"], "version_id": c["version_id"], "content_sha256": c["content_sha256"], "evidence": [e for e in c["evidence"] if e["type"] in ("structural", "lexical")]} for c in package["candidates"]]
    return {"case_id": package["case_id"], "candidates": sorted(seen, key=order)}


def reconcile_packet(packet: dict, ranking: dict) -> list[str]:
    """Candidates that only one of packet and ranking holds, or under another content."""
    p, r = ({c["path"]: c["content_sha256"] for c in d["candidates"]} for d in (packet, ranking))
    return sorted([f"{x}: missing" for x in r.keys() - p.keys()] + [f"{x}: unknown" for x in p.keys() - r.keys()] + [f"{x}: other content" for x in p.keys() & r.keys() if p[x] != r[x]])


def annotation_template(packet: dict) -> dict:
    empty = {"classification": None, "evidence_sufficiency": None, "primary_rationale": None}
    return {"case_id": packet["case_id"], "annotator_id": None, "annotations": [{"path": c["path"], "version_id": c["version_id"], "reference_assessment": dict(empty), "blinding_verification": dict.fromkeys(BLINDING, False)} for c in packet["candidates"]]}


def annotation_problems(annotation: dict, packet: dict) -> list[str]:
    """What keeps a filled template from counting."""
    out = [] if annotation.get("annotator_id") else ["no annotator"]
    paths = [a.get("path") for a in annotation.get("annotations", [])]
    wanted = {c["path"] for c in packet["candidates"]}
    if len(set(paths)) != len(paths) or set(paths) != wanted:
        out.append("the candidates differ from the packet's")
    for a in annotation.get("annotations", []):
        said = a.get("reference_assessment") or {}
        if said.get("classification") not in CLASSIFICATIONS:
            out.append(f"{a.get('path')}: unknown classification")
        if said.get("evidence_sufficiency") not in SUFFICIENCY:
            out.append(f"{a.get('path')}: unknown sufficiency")
        if any((a.get("blinding_verification") or {}).get(b) is not False for b in BLINDING):
            out.append(f"{a.get('path')}: not blinded")
    return out


def gate(problems: list[str], annotators: int, least: int = 2) -> str:
    """RELEASED only with enough annotators and without any problem."""
    return "RELEASED" if not problems and annotators >= least else "BLOCKED"


def bind_identity(manifest: dict, tables: dict[str, str], model: dict) -> dict:
    """Ties a run to its manifest, the digests of its tables and its embedding model."""
    body = {"manifest_sha256": digest(manifest), "tables": dict(sorted(tables.items())), "model": model}
    return body | {"identity": digest(body)}


def identity_problems(identity: dict, manifest: dict, tables: dict[str, str], model: dict) -> list[str]:
    now = bind_identity(manifest, tables, model)
    return [k for k in ("manifest_sha256", "tables", "model", "identity") if canonical(identity.get(k)) != canonical(now[k])]


def pin_problems(pin: dict, found: dict) -> list[str]:
    """Fields in which an embedding model differs from the pinned one."""
    return sorted(k for k in pin.keys() | found.keys() if pin.get(k) != found.get(k))
