"""One frozen record of job parameters. No job reads the clock or the environment itself."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime


@dataclass(frozen=True)
class Params:
    # content rules
    thin_words: int = 300
    low_value_words: int = 600
    # ad rules
    max_ads: int = 6
    words_per_ad: int = 220
    ad_empty_words: int = 80
    ad_thin_words: int = 300
    # near-duplicate pages
    duplicate_threshold: float = 0.86
    duplicate_sketch: int = 128
    duplicate_min_words: int = 150
    duplicate_candidates: int = 30   # size of the ranked candidate list
    duplicate_bucket: int = 200      # recency window of the bounded candidate index
    # external copies
    copy_min_words: int = 250
    copy_review: float = 0.35
    copy_high: float = 0.65
    copy_queries: int = 2
    copy_candidates: int = 10
    # third-party results
    model_min_confidence: int = 70
    model_name: str = "policy-model"
    moderation_threshold: float = 0.55
    budget_model: int = 0            # pages a scan sends to each paid add-on; zero: no limit
    budget_browser: int = 0
    budget_copy: int = 0
    # discovery
    max_discovered_urls: int = 100_000
    max_sitemaps: int = 0            # request option; zero: no limit
    max_body_bytes: int = 5_000_000
    requests_per_second: float = 1.5
    bot_name: str = "sitegauge"
    # scan bookkeeping
    batch_size: int = 10
    page_workers: int = 6
    traffic_days: int = 7
    traffic_rows: int = 0            # rows of the displayed traffic report; zero: all paths
    stale_minutes: int = 30
    open_stage_days: int = 365       # a running stage without a finish for so long is given up
    claim_days: int = 7              # how long a stream remembers who works on a target
    late_events: str = "10 minutes"  # how far events may arrive out of order
    ruleset: str = "1.4.0"
    scan_type: str = "full"
    use_model: bool = False
    use_browser: bool = False
    use_copy: bool = False
    force_rescan: bool = False
    now: datetime = datetime(2024, 2, 1)
    # what a report shows of stored texts
    shown_headline: int = 300
    shown_text: int = 5000
    shown_line: int = 1000
    shown_priorities: int = 8
    shown_limitations: int = 5
    shown_titles: int = 60
    shown_title: int = 180
    # physical layout
    salts: int = 16          # ways a hot key is split
    chunk: int = 65_536      # ids per chunk when numbering rows inside a group
    block: int = 256         # rows per side of one comparison block
    stage_run: int = 64      # consecutive targets that share one state of stage durations

    # clamps applied by every consumer
    @property
    def sketch(self) -> int:
        return max(32, self.duplicate_sketch)

    @property
    def bucket(self) -> int:
        return max(10, self.duplicate_bucket)

    @property
    def candidates(self) -> int:
        return max(1, self.duplicate_candidates)

    @property
    def page_batch(self) -> int:
        return max(1, min(100, self.batch_size))

    @property
    def copy_threshold(self) -> float:
        return max(0.05, min(1.0, self.copy_review))

    @property
    def copy_high_threshold(self) -> float:
        return max(self.copy_threshold, min(1.0, self.copy_high))

    @property
    def open_stage_ms(self) -> int:
        return self.open_stage_days * 86_400_000

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


DEFAULT = Params()
