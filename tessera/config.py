"""Layered configuration and validation of compare requests."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


class TesseraError(Exception):
    """Base of all errors that the engine raises on purpose (M4)."""

    code = "internal"


class InvalidRequest(TesseraError, ValueError):
    code = "invalidArgument"


class FileMissing(TesseraError):
    code = "fileNotFound"


class UnsupportedFile(TesseraError):
    code = "unsupportedFileType"


class ParseFailed(TesseraError):
    code = "parseFailed"


class ExportFailed(TesseraError):
    code = "exportFailed"


class JobConflict(TesseraError):
    code = "jobConflict"


class JobCancelled(TesseraError):
    code = "cancelled"


class ModelUnavailable(TesseraError):
    code = "modelUnavailable"


@dataclass
class CompareConfig:
    default_chunk_level: str = "paragraph"
    similarity_threshold: float = 0.7
    candidate_top_k: int = 100
    enable_semantic: bool = False
    enable_fact_conflict: bool = True
    ignore_whitespace: bool = True
    ignore_punctuation: bool = True
    ignore_case: bool = True
    detect_moved_paragraph: bool = True
    scope: str = "full"
    ignore_templates: bool = True
    language: str = "auto"


@dataclass
class ParserConfig:
    remove_header_footer: bool = True
    preserve_page_number: bool = True
    detect_table: bool = True
    min_paragraph_length: int = 10


@dataclass
class ExportConfig:
    default_format: str = "html"
    include_raw_text: bool = True
    include_config: bool = True


@dataclass
class SecurityConfig:
    allow_cloud_model: bool = False


@dataclass
class AppConfig:
    compare: CompareConfig = field(default_factory=CompareConfig)
    parser: ParserConfig = field(default_factory=ParserConfig)
    export: ExportConfig = field(default_factory=ExportConfig)
    security: SecurityConfig = field(default_factory=SecurityConfig)


def _apply(target: object, patch: dict, where: str) -> None:
    if not isinstance(patch, dict):
        raise InvalidRequest(f"{where or 'config'}: expected an object")
    for f in fields(target):
        if patch.get(f.name) is None:  # null is unset, unknown keys are ignored
            continue
        value, now = patch[f.name], getattr(target, f.name)
        if is_dataclass(now):
            _apply(now, value, f"{where}{f.name}.")
            continue
        ok = isinstance(value, type(now)) and not (isinstance(value, bool) and not isinstance(now, bool))
        if isinstance(now, float) and isinstance(value, int) and not isinstance(value, bool):
            value, ok = float(value), True
        if not ok:
            raise InvalidRequest(f"{where}{f.name}: expected {type(now).__name__}, got {value!r}")
        setattr(target, f.name, value)


def merged_config(*layers: dict | None) -> AppConfig:
    """Built-in defaults below the given layers (user, workspace, task); later layers win key by key."""
    out = AppConfig()
    for layer in layers:
        if layer:
            _apply(out, layer, "")
    return out


@dataclass(frozen=True)
class CompareRequest:
    document_ids: tuple
    base_document: object = None
    config: CompareConfig = field(default_factory=CompareConfig)


def validated_request(document_ids: list, base_document: object = None, config: CompareConfig | None = None) -> CompareRequest:
    """2 to 10 distinct documents, a base among them, known enums, clamped numbers."""
    config = CompareConfig(**vars(config or CompareConfig()))
    ids = tuple(dict.fromkeys(document_ids))
    if not 2 <= len(ids) <= 10:
        raise InvalidRequest(f"a comparison takes 2 to 10 different documents, not {len(ids)}")
    if base_document is not None and base_document not in ids:
        raise InvalidRequest("the base document is not among the documents")
    if config.default_chunk_level not in ("section", "paragraph", "sentence"):
        raise InvalidRequest(f"no chunk level {config.default_chunk_level!r}")
    if config.scope not in ("full", "tech", "business"):
        raise InvalidRequest(f"no scope {config.scope!r}")
    config.similarity_threshold = min(max(config.similarity_threshold, 0.2), 0.99)
    config.candidate_top_k = min(max(config.candidate_top_k, 5), 1000)
    return CompareRequest(ids, base_document, config)
