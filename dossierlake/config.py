"""Settings of an index: defaults and a YAML file of sections and plain values."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The default settings.


@dataclass(frozen=True)
class Settings:
    root_folders: tuple[str, ...] = ()
    data_dir: str = "data"
    chunk_size: int = 1000
    chunk_overlap: int = 150
    supported_extensions: tuple[str, ...] = (".pdf", ".docx", ".ppt", ".pptx")
    top_k: int = 20
    keyword_weight: float = 0.4
    vector_weight: float = 0.6
    embedding_dimensions: int = 384
    exclude_patterns: tuple[str, ...] = ("견적", "원가", "계약", "개인정보")
    exclude_reference_materials: bool = True
    stop_words: tuple[str, ...] = ()


YAML_KEYS = {
    ("indexing", "chunk_size"): "chunk_size", ("indexing", "chunk_overlap"): "chunk_overlap",
    ("indexing", "supported_extensions"): "supported_extensions", ("search", "top_k"): "top_k",
    ("search", "keyword_weight"): "keyword_weight", ("search", "vector_weight"): "vector_weight",
    ("embedding", "dimensions"): "embedding_dimensions", ("security", "exclude_patterns"): "exclude_patterns",
    ("security", "exclude_reference_materials"): "exclude_reference_materials", ("indexing", "stop_words"): "stop_words",
}


def load_settings(path: str) -> Settings:
    """Values of the file over the defaults; unknown keys are ignored."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        document = yaml.safe_load(handle) or {}
    found = {}
    for name in ("root_folders", "data_dir"):
        if document.get(name) is not None:
            found[name] = tuple(document[name]) if isinstance(document[name], list) else document[name]
    for (section, key), name in YAML_KEYS.items():
        value = (document.get(section) or {}).get(key)
        if value is not None:
            found[name] = tuple(value) if isinstance(value, list) else value
    return replace(Settings(), **found)
