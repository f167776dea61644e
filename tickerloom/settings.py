"""Typed settings with the pipeline's default parameter values.

Settings are plain frozen dataclasses on the driver; everything that has to
reach executors is baked into column expressions as literals.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

# --- fixed values: must equal the published pipeline's for matching results ---

# Ordered: the first key contained in a lower-cased source name wins.
SOURCE_WEIGHTS: tuple[tuple[str, float], ...] = (
    ("reuters", 1.0),
    ("nse_bse_official", 1.0),
    ("economic_times", 0.9),
    ("business_standard", 0.85),
    ("moneycontrol", 0.8),
    ("moneycontrol_hindi", 0.8),
    ("ndtv_profit", 0.75),
    ("syndicated", 0.3),
    ("default", 0.5),
)

# Ordered: the last pattern found in a headline wins.
TAG_PATTERNS: tuple[tuple[str, str], ...] = (
    ("RELIANCE", "RELIANCE"),
    ("HDFC", "HDFCBANK"),
    ("INFOSYS|INFY", "INFY"),
    ("ICICI", "ICICIBANK"),
    ("SBI|STATE BANK", "SBIN"),
    ("TCS|TATA CONSULTANCY", "TCS"),
    ("KOTAK", "KOTAKBANK"),
    ("AXIS", "AXISBANK"),
    ("BHARTI|AIRTEL", "BHARTIARTL"),
    ("BAJAJ FIN", "BAJFINANCE"),
    ("ADANI", "ADANIENT"),
    ("WIPRO", "WIPRO"),
    ("TATA MOTOR", "TATAMOTORS"),
)

TICKER_LISTS: dict[str, tuple[str, ...]] = {
    "subset_5": ("RELIANCE", "SBIN", "HDFCBANK", "INFY", "ICICIBANK"),
    "final_15": (
        "BAJFINANCE", "BHARTIARTL", "BPCL", "HDFCBANK", "ICICIBANK", "INFY", "ITC", "KOTAKBANK",
        "NTPC", "ONGC", "POWERGRID", "RELIANCE", "SBIN", "TATASTEEL", "WIPRO",
    ),
}

PRICE_FEATURES: tuple[str, ...] = (
    "log_ret", "vol_norm", "gap_open", "rsi_14", "ma20_ratio", "ma50_ratio",
    "ma200_ratio", "bb_width", "atr_14_norm", "vol_z", "log_ret_z",
)

MARKET_CLOSE_SECONDS = 55_800  # 15:30 as seconds of the day
MARKET_ZONE = "Asia/Kolkata"

# Hardware profiles: per-profile number of dropout passes and training length.
PROFILES: dict[str, dict[str, Any]] = {
    "4gb": {"mc_dropout_passes": 10, "epochs": 30, "train_batch_size": 32},
    "8gb": {"mc_dropout_passes": 30, "epochs": 50, "train_batch_size": 64},
    "full": {"mc_dropout_passes": 50, "epochs": 100, "train_batch_size": 64},
}

# Profile key -> (settings section, field).
PROFILE_TARGETS: dict[str, tuple[str, str]] = {
    "mc_dropout_passes": ("model", "mc_dropout_passes"),
    "epochs": ("training", "epochs"),
    "train_batch_size": ("training", "batch_size"),
}

# --- end of fixed values ---

SENTIMENT_WINDOWS: tuple[int, ...] = (1, 3, 7)


def sentiment_columns(windows: tuple[int, ...] = SENTIMENT_WINDOWS) -> tuple[str, ...]:
    return tuple(f"{part}_{days}d" for days in windows for part in ("pos", "neg", "neu"))


@dataclass(frozen=True)
class FeatureSettings:
    rsi_period: int = 14
    ma_periods: tuple[int, int, int] = (10, 20, 50)
    atr_period: int = 14
    bollinger_period: int = 20
    volume_norm_window: int = 20
    zscore_window: int = 50
    zscore_min_periods: int = 30
    window_min: int = 5
    window_max: int = 15
    window_atr_scale: float = 20.0


@dataclass(frozen=True)
class NlpSettings:
    lang_confidence_threshold: float = 0.85
    hindi_min_articles: int = 3
    sentiment_windows: tuple[int, ...] = SENTIMENT_WINDOWS
    distill_max_samples: int = 5000


@dataclass(frozen=True)
class ModelSettings:
    dropout: float = 0.3
    mc_dropout_passes: int = 30
    confidence_threshold: float = 0.65


@dataclass(frozen=True)
class TrainingSettings:
    epochs: int = 50
    batch_size: int = 64
    label_threshold: float = 0.008
    label_horizon_days: int = 3
    weight_decay: float = 1e-5
    train_start: str = "2021-01-01"
    train_end: str = "2024-06-30"
    val_start: str = "2024-07-01"
    val_end: str = "2024-10-31"
    test_start: str = "2024-11-01"
    test_end: str = "2025-01-27"

    @property
    def split_bounds(self) -> tuple[tuple[str, str, str], ...]:
        return (
            ("train", self.train_start, self.train_end),
            ("val", self.val_start, self.val_end),
            ("test", self.test_start, self.test_end),
        )


@dataclass(frozen=True)
class EvaluationSettings:
    rolling_window_days: int = 30
    calibration_bins: int = 10
    abstain_sigma: float = 1.5
    tier_sigmas: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)


@dataclass(frozen=True)
class AdaptiveSettings:
    tier1_decay: float = 0.95
    tier2_ewc_lambda: float = 400.0
    tier2_nudge_days: int = 5
    tier2_nudge_lr: float = 1e-5
    tier2_nudge_steps: int = 5
    tier3_window_years: int = 3


@dataclass(frozen=True)
class CacheSettings:
    force_rerun: bool = False
    sentiment_ttl_days: float = 1
    features_ttl_days: float = 7
    fusion_ttl_days: float = 7


@dataclass(frozen=True)
class Settings:
    profile: str = "full"
    seed: int = 123
    features: FeatureSettings = field(default_factory=FeatureSettings)
    nlp: NlpSettings = field(default_factory=NlpSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    training: TrainingSettings = field(default_factory=TrainingSettings)
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)
    adaptive: AdaptiveSettings = field(default_factory=AdaptiveSettings)
    cache: CacheSettings = field(default_factory=CacheSettings)
    source_weights: tuple[tuple[str, float], ...] = SOURCE_WEIGHTS
    tag_patterns: tuple[tuple[str, str], ...] = TAG_PATTERNS
    tickers: tuple[str, ...] | None = None  # all that have prices

    def signature(self, *sections: str) -> str:
        """Stable hash of the named sections (all fields that shape the data)."""
        picked = {name: _plain(getattr(self, name)) for name in sections}
        return hashlib.md5(json.dumps(picked, sort_keys=True).encode()).hexdigest()


def _plain(value: Any) -> Any:
    return dataclasses.asdict(value) if dataclasses.is_dataclass(value) else value


def apply_profile(settings: Settings, profile: str) -> Settings:
    """Overlay one hardware profile; an unknown name leaves the values alone."""
    out = dataclasses.replace(settings, profile=profile)
    for key, value in PROFILES.get(profile, {}).items():
        section, name = PROFILE_TARGETS[key]
        out = dataclasses.replace(out, **{section: dataclasses.replace(getattr(out, section), **{name: value})})
    return out


def from_mapping(raw: dict[str, Any], profile: str | None = None) -> Settings:
    """Build settings from a parsed config tree; unknown keys are ignored."""
    out = Settings()
    sections = ("features", "nlp", "model", "training", "evaluation", "adaptive", "cache")
    for section in sections:
        current = getattr(out, section)
        known = {f.name for f in dataclasses.fields(current)}
        given = {k: tuple(v) if isinstance(v, list) else v
                 for k, v in (raw.get(section) or {}).items() if k in known}
        out = dataclasses.replace(out, **{section: dataclasses.replace(current, **given)})
    if raw.get("source_weights"):
        out = dataclasses.replace(out, source_weights=tuple(raw["source_weights"].items()))
    tickers = raw.get("tickers") or {}
    if tickers:
        chosen = tickers.get(tickers.get("active", "subset_5"))
        out = dataclasses.replace(out, tickers=tuple(chosen) if chosen else None)
    seed = (raw.get("reproducibility") or {}).get("seed")
    if seed is not None:
        out = dataclasses.replace(out, seed=int(seed))
    return apply_profile(out, profile or raw.get("vram_profile", "8gb"))


def load(path: str, profile: str | None = None) -> Settings:
    """Read a YAML (or JSON) config file from the driver."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        return from_mapping(json.loads(text), profile)
    try:
        import yaml
    except ImportError as exc:  # PyYAML is optional
        raise RuntimeError("reading a YAML config needs PyYAML; pass a .json config instead") from exc
    return from_mapping(yaml.safe_load(text) or {}, profile)
