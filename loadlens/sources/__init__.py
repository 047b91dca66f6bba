"""Source catalog, declared schemas and loading."""

from loadlens.sources.loader import (all_empty, clean_frame, declared_schema, empty_source, load_all, load_source,
                                     preview, profile, read_raw)
from loadlens.sources.specs import CATALOG, SourceSpec

__all__ = ["CATALOG", "SourceSpec", "all_empty", "clean_frame", "declared_schema", "empty_source", "load_all",
           "load_source", "preview", "profile", "read_raw"]
