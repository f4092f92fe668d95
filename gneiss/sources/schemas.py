"""The record schemas of the store. ``TAIL`` is common to most records."""

from __future__ import annotations

TAIL = "knowledgeKind string, confidence decimal(3,2), unknownState struct<hasUnknownData:boolean,unknownReason:string>, metadata string, fingerprint string"

# Tables, their columns and their keys.
SCHEMAS = {
    "snapshots": "stableKey string, repositoryStableKey string, branchName string, commitSha string, startedUtc timestamp_ntz, completedUtc timestamp_ntz, extractionVersion string, status string, warnings array<string>, errors array<string>, metadata string",
    "repositories": "stableKey string, name string, rootPath string, remoteUrl string, defaultBranch string, metadata string",
    "solutions": "repositoryStableKey string, stableKey string, name string, path string, metadata string",
    "nodes": "snapshotStableKey string, stableKey string, nodeKind string, displayName string, qualifiedName string, searchName string, language string, projectStableKey string, parentNodeStableKey string, ownership string, externalCategory string, primaryEvidenceStableKey string, " + TAIL,
    "edges": "snapshotStableKey string, stableKey string, edgeKind string, sourceNodeStableKey string, targetNodeStableKey string, isDirect boolean, primaryEvidenceStableKey string, " + TAIL,
    "evidence": "snapshotStableKey string, stableKey string, evidenceKind string, filePath string, startLine int, endLine int, symbolName string, containingSymbol string, snippetHash string, snippetPreview string, " + TAIL,
    "findings": "snapshotStableKey string, stableKey string, ruleCode string, ruleVersion string, severity string, status string, title string, description string, primaryNodeStableKey string, primaryEvidenceStableKey string, firstSeenSnapshotStableKey string, latestSeenSnapshotStableKey string, suppressionReason string, suppressedBy string, affectedNodeStableKeys array<string>, evidenceStableKeys array<string>, historyKey string, " + TAIL,
    "metrics": "snapshotStableKey string, stableKey string, metricKind string, scopeKind string, nodeStableKey string, edgeStableKey string, primaryEvidenceStableKey string, name string, numericValue decimal(38,6), textValue string, unit string, confidence decimal(3,2), unknownState struct<hasUnknownData:boolean,unknownReason:string>, metadata string, fingerprint string",
    "summaries": "snapshotStableKey string, stableKey string, summaryKind string, targetStableKey string, format string, title string, content string, metadata string, fingerprint string",
    "rules": "ruleCode string, version string, name string, category string, severity string, defaultStatus string, enabled boolean, description string, definitionJson string, sourceUrls array<string>, isBuiltIn boolean, ownerScope string, metadata string",
    "runs": "runId string, status string, startedUtc timestamp_ntz, completedUtc timestamp_ntz, progress int, diagnostics string",
}
KEYS = {name: ("snapshotStableKey", "stableKey") if "snapshotStableKey" in schema.split(",")[0] else ("ruleCode", "version") if name == "rules" else ("runId",) if name == "runs" else ("stableKey",) for name, schema in SCHEMAS.items()}
