"""Settings, with the defaults that hold when no file is given."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

# A settings file's sections and names, by our names.
NAMES = {
    "segment_rows": ("WAL", "WALSegmentationFactor"),
    "memtable_rows": ("MemTable", "memTableMaxCap"),
    "flush_percent": ("MemTable", "memTableFlush"),
    "cache_size": ("LRUCache", "cacheSize"),
    "summary_step": ("SSTable", "summaryBlockingFactor"),
    "levels": ("LSMTree", "LSMTreeLevel"),
    "compaction": ("LSMTree", "LSMAlgorithm"),
    "minimum_runs": ("LSMTree", "LSMMinimum"),
    "limit_seconds": ("TokenBucket", "TokenTime"),
    "limit_number": ("TokenBucket", "TokenNumber"),
    "page_size": ("Pagination", "ResultsNumber"),
    "hll_p": ("HLL", "p"),
    "cms_epsilon": ("CMS", "p"),
    "cms_delta": ("CMS", "d"),
    "bloom_n": ("BloomFilter", "n"),
    "bloom_p": ("BloomFilter", "p"),
}


@dataclass(frozen=True)
class Config:
    segment_rows: int = 5
    memtable_rows: int = 5
    flush_percent: float = 80
    cache_size: int = 14
    summary_step: int = 20
    levels: int = 4
    compaction: int = 1  # 1: size-tiered, 2: leveled
    minimum_runs: int = 3
    limit_seconds: int = 10
    limit_number: int = 5
    page_size: int = 5
    hll_p: int = 8
    cms_epsilon: float = 0.1
    cms_delta: float = 0.01
    bloom_n: int = 20
    bloom_p: float = 0.1

    @classmethod
    def read(cls, path: str) -> Config:
        """A JSON object of objects of numbers; a missing file gives the
        defaults, and so does a missing name."""
        if not Path(path).exists():
            return cls()
        held = json.loads(Path(path).read_text())
        found = {}
        for f in fields(cls):
            section, name = NAMES[f.name]
            if name in held.get(section, {}):
                found[f.name] = type(f.default)(held[section][name])
        return cls(**found)
