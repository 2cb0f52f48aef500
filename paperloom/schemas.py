"""Declared schemas of the data model, as DDL."""

from __future__ import annotations

LOCATOR = "struct<kind:string,sheetName:string,range:string,page:int,paragraphId:string,slide:int>"
CHUNK = f"""id string, docId string, schemaVersion int, sourceType string, structureType string, locator {LOCATOR}, title string, text string,
    maskedText string, sensitivity string, aiUsePolicy string, sensitivityReason string, sensitivitySource string, extractionProvider string,
    extractionWarnings array<string>, maskedSpansCount int, ruleHits map<string,bigint>, sourceHash string, createdAt string, updatedAt string"""
CURATOR = "struct<documentType:string,businessDomain:string,sensitivity:string,freshness:string,isAuthoritativeCandidate:boolean,aiUsePolicy:string,rationale:string,completedAt:timestamp,modelId:string>"
MASKER = """struct<decision:string,provider:string,maskedSpansCount:int,ruleHits:map<string,bigint>,residualRisk:struct<detected:boolean,reasons:array<string>>,
    rationale:string,recommendedSensitivity:string,sourceContentHash:string,aiSafeSchemaVersion:int,completedAt:timestamp,modelId:string>"""
EXTERNAL = "struct<provider:string,workspaceMimeType:string,fileId:string,name:string,webViewLink:string,modifiedTime:string,importedAt:string,exportedAt:string,exportMimeType:string>"
ERROR = "struct<message:string,occurredAt:timestamp>"
DOCUMENT = f"""id string, fileName string, contentType string, contentSha256 string, sourceKind string, sourceSubtype string, storagePath string,
    aiSafeStoragePath string, status string, schemaVersion int, byteSize bigint, createdAt timestamp, updatedAt timestamp, documentType string,
    businessDomain string, sensitivity string, freshness string, aiUsePolicy string, sensitivitySource string, originalCuratorSensitivity string,
    sensitivityReason string, isAuthoritativeCandidate boolean, maskingPending boolean, latestConversionEvalId string, externalSource {EXTERNAL},
    curator {CURATOR}, masker {MASKER}, curatorError {ERROR}, maskerError {ERROR}, conversionError {ERROR}"""
BLOCK = """struct<blockId:string,kind:string,text:string,locator:struct<pageNumber:int,slideNumber:int,tableIndex:int,rowIndex:int,bbox:array<double>>,
    metadata:map<string,string>>"""
PAGES = f"array<struct<pageNumber:int,blocks:array<{BLOCK}>>>"
DOCUMENT_IR = f"schemaVersion int, source struct<fileName:string,mediaType:string,sourceKind:string,sourceSubtype:string>, pages {PAGES}"
OCR_PAGES = "array<struct<pageNumber:int,blocks:array<struct<kind:string,text:string,confidence:double,bbox:array<double>>>>>"
SLIDES = "array<struct<slideNumber:int,title:string,blocks:array<struct<kind:string,text:string>>>>"
AUDIT = "eventId string, occurredAt string, tenantId string, actor string, action string, targetDocId string, result string, details map<string,string>"
FLAG = "flagId string, defaultEnabled boolean, enabledTenants array<string>, expiresAt string"
EXPECTED = "documentId string, expectedFields array<string>, notes string"
SNAPSHOT = """documentType string, businessDomain string, sensitivity string, freshness string, isAuthoritativeCandidate boolean, aiUsePolicy string,
    rationale string, fileName string, sourcePath string,
    maskerEvaluation struct<residualRisk:struct<detected:boolean,reasons:array<string>>,recommendedSensitivity:string,rationale:string>"""
