"""Settings: how records map to documents, chunk sizes, adapters. Read from TOML, hashed for drift."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import asdict, dataclass, field, fields
from fnmatch import translate


#: What a new index begins with; every value is the one that holds without it.
DEFAULT_TOML = """[mapper.fields]
text_fields = []
structured_fields = []
entity_fields = []

[chunk]
size_tokens = 320
overlap_tokens = 64

[embedder]
enabled = true
name = "hashing"

[entities]
min_name_len = 3
single_word_match = "exact-case"
"""


@dataclass(frozen=True)
class FieldMap:
    """How a record becomes a document; what is empty is found out."""

    record_path: str | None = None
    record_id: str | None = None
    title_template: str | None = None
    text_fields: tuple[str, ...] = ()
    structured_fields: tuple[str, ...] = ()
    entity_fields: tuple[str, ...] = ()
    match: str | None = None

    @classmethod
    def of(cls, values: dict) -> FieldMap:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


@dataclass(frozen=True)
class Settings:
    default: FieldMap = FieldMap()
    sources: tuple[FieldMap, ...] = ()
    size_tokens: int = 320
    overlap_tokens: int = 64
    token_factor: float = 0.75
    embedder: str = "hashing"
    embed: bool = True
    contextual: bool = False
    parsers: dict = field(default_factory=lambda: {"pdf": "pdfium", "docx": "docx", "text": "text"})
    reranker: str | None = None
    clusters: int | str = "auto"
    min_name_len: int = 3
    single_word_match: str = "exact-case"
    extra_org_suffixes: tuple[str, ...] = ()
    store: str = "parquet"

    @classmethod
    def load(cls, text: str) -> Settings:
        raw = tomllib.loads(text)
        mapper, chunk, embed, ent = raw.get("mapper", {}), raw.get("chunk", {}), raw.get("embedder", {}), raw.get("entities", {})
        rerank, cluster = raw.get("reranker", {}), raw.get("cluster", {})
        return cls(
            default=FieldMap.of(mapper.get("fields", {})), sources=tuple(FieldMap.of(s) for s in mapper.get("sources", [])),
            size_tokens=chunk.get("size_tokens", 320), overlap_tokens=chunk.get("overlap_tokens", 64), token_factor=chunk.get("token_estimate_factor", 0.75),
            embedder=embed.get("name", "hashing"), embed=embed.get("enabled", True), contextual=embed.get("contextual", False),
            parsers=cls().parsers | raw.get("parser", {}), reranker=rerank.get("name", "cross-encoder") if rerank.get("enabled") else None, clusters=cluster.get("k", "auto"),
            min_name_len=ent.get("min_name_len", 3), single_word_match=ent.get("single_word_match", "exact-case"), extra_org_suffixes=tuple(ent.get("extra_org_suffixes", ())), store=raw.get("store", {}).get("name", "parquet"),
        )

    def map_for(self, path: str) -> FieldMap:
        """The first source whose pattern matches (its * crosses /; relative ones match anywhere), else the default."""
        for s in self.sources:
            pattern = s.match or "*"
            pattern = pattern if pattern.startswith(("/", "*")) else f"*/{pattern}"
            if re.match(translate(pattern), path.removeprefix("file:")):
                return s
        return self.default

    def map_hash(self) -> str:
        spec = json.dumps([asdict(self.default), [asdict(s) for s in self.sources]], sort_keys=True)
        return hashlib.sha1(spec.encode()).hexdigest()[:12]

    def full_hash(self) -> str:
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:12]
