"""Options of extraction and scoring: packaged defaults, JSON files, and what a caller gives over them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Options:
    """Defaults are fixed values."""

    batch_size: int = 512
    num_bins: int = 15
    bin_size: int = 500
    chunk_size: int = 256
    overlap: int = 16
    stride: int = 4
    cpg: int = 0
    chg: int = 0
    chh: int = 0
    m6A: int = 0
    pore_type: str = "R9.4.1"
    frequency: str = "4khz"
    dorado_version: float = 0.71
    mapq_thres: int = 0
    negative_thres: int = 0
    positive_thres: int = 100


#: Presets by name: what each changes.
PRESETS: dict[str, dict[str, Any]] = {"default": {}, "distilled": {"stride": 8}}


def options(source: str | Path | Mapping[str, Any] | Options = "default") -> Options:
    """Options of a preset's name, of a JSON file, of a mapping, or as they are; unknown names and fields raise."""
    if isinstance(source, Options):
        return source
    if isinstance(source, Mapping):
        return Options(**source)
    if str(source) in PRESETS:
        return Options(**PRESETS[str(source)])
    if not Path(source).is_file():
        raise FileNotFoundError(f"neither a preset ({', '.join(PRESETS)}) nor a file: {source}")
    return Options(**json.loads(Path(source).read_text(encoding="utf-8")))


def merged(given: Mapping[str, Any], defaults: Options) -> Options:
    """defaults with what is given and not None; other keys are ignored."""
    known = {f.name for f in fields(Options)}
    return replace(defaults, **{k: v for k, v in given.items() if k in known and v is not None})


def save(o: Options, path: str | Path) -> None:
    Path(path).write_text(json.dumps(asdict(o), indent=2), encoding="utf-8")
