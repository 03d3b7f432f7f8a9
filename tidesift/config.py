"""Business constants of the outlier rules and reports."""

from __future__ import annotations

from dataclasses import dataclass

# Class, segment and weekday names used in the result tables.
HARMFUL, BENIGN, STRATEGIC, NORMAL = "Harmful", "Benign", "Strategic", "Normal"
OUTLIER_CLASSES = (HARMFUL, BENIGN, STRATEGIC)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds of the rules; the defaults are the published ones."""

    min_price: float = 0.1
    max_quantity: float = 10000.0
    fence_k: float = 1.5
    low_tail: float = 0.01
    high_tail: float = 0.99
    trim: float = 0.05
    wholesaler: str = "wholesaler"
    private: str = "private"
    weekend_days: tuple[int, ...] = (5, 6)  # Monday = 0
    peak_months: tuple[int, ...] = (9, 10, 11)
    off_months: tuple[int, ...] = (1, 2)
    top_harmful: int = 20
    top_strategic: int = 30
    top_categories: int = 15
    histogram_bins: int = 50
    scatter_rows: int = 20_000
    seed: int = 42


@dataclass(frozen=True)
class ForestConfig:
    """Random-forest and validation settings."""

    num_trees: int = 300
    min_leaf: int = 2
    max_depth: int = 30  # the deepest tree MLlib accepts
    max_bins: int = 256
    seed: int = 42
    report_test_share: float = 0.20
    validation_test_share: float = 0.25
    retrain_seeds: tuple[int, ...] = (41, 42, 43, 44, 45)
    fits_at_once: int = 5  # retrains fitted side by side at most; each holds its own bagged copy of the training part
    cells_at_once: int = 450_000_000  # rows x trees of the fits side by side, some 13 bytes each; a single fit may have more
    permutation_repeats: int = 5
    permutation_seed: int = 100  # plus the run number
    listed_features: int = 10
    compared_features: int = 3
    train_partitions: int | None = None  # None: as many as train_rows_per_partition asks for, spark.sql.shuffle.partitions at most
    train_rows_per_partition: int = 30_000
    fewest_partitions: int = 24  # so many are allowed for any number of rows
    max_memory_mb: int = 512  # histogram memory per pass: more of it means fewer scans per tree level
    cache_nodes: bool = True  # keep each row's tree nodes between passes: same trees, without walking down all of them in every pass


RULES = RuleConfig()
FOREST = ForestConfig()
