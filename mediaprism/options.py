"""What a run may be asked to tolerate. Times are whole microseconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    gap_us: int = 100_000
    duration_pct: int = 5
    bitrate_pct: int = 10
    frame_rate_pct: int = 2
    target_slack_us: int = 500_000
    stall_tolerance: int = 3
    clear_lead_us: int | None = 2_000_000
    clear_lead_slack_us: int = 100_000
    period_late_us: int = 500_000
    clock_skew_us: int = 1_000_000
    #: ``apple``, ``dash-if`` (which has no rules yet and says so) or ``none``.
    profile: str = "apple"
    profile_duration_pct: int = 10


# Recommended average bit rates (kbit/s) of AVC rungs by coded size.
AVC_TIERS = (
    (416, 234, 145),
    (640, 360, 365),
    (768, 432, 730),
    (960, 540, 2000),
    (1280, 720, 3000),
    (1920, 1080, 6000),
    (2560, 1440, 9000),
    (3840, 2160, 16000),
)
