"""Settings of the bar analytics, immutable and without side effects on import."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Window lengths, shares, the seed, and the search's names, ranges and their order, which the draws depend on.
    ma_windows: tuple[int, ...] = (5, 10, 20, 60)
    short_windows: tuple[int, ...] = (5, 10, 20)
    rsi_window: int = 14
    williams_window: int = 14
    band_window: int = 21
    band_width: float = 2.0
    macd_spans: tuple[int, int] = (12, 26)
    momentum_window: int = 10
    return_lags: tuple[int, ...] = (0, 1, 2, 3, 5)
    volume_gate: float = 0.05
    train_share: float = 0.85
    val_share: float = 0.05
    block_months: int = 3
    tau: float = 0.7
    seed: int = 42
    draws: int = 40
    trees: int = 2000
    patience: int = 50
    # inclusive ranges of the random search
    search: dict = field(
        default_factory=lambda: {
            "num_leaves": (15, 255),
            "learning_rate": (0.005, 0.1),
            "max_depth": (3, 12),
            "min_child_samples": (10, 120),
            "feature_fraction": (0.5, 1.0),
            "bagging_fraction": (0.5, 1.0),
            "lambda_l1": (1e-4, 10.0),
            "lambda_l2": (1e-4, 10.0),
        }
    )


DEFAULT = Settings()
KEYS = ("series", "date")
OHLCV = ("open", "high", "low", "close", "volume")
TARGET = "target_next_log_return"
