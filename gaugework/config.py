"""Every threshold the analyses use, in one immutable object.

The values are fixed: results only agree with the published behaviour of the
tool this engine replaces when they do.  Pass a changed copy
(``dataclasses.replace``) to tune an analysis.
"""

from __future__ import annotations

from dataclasses import dataclass

ROW_ID = "_row_id"


@dataclass(frozen=True)
class Thresholds:
    # Fixed values.
    preview_rows: int = 10
    large_table_rows: int = 100_000
    missing_red_flag: float = 0.30
    missing_column_warning: float = 0.50
    iqr_multiplier: float = 1.5
    zscore_limit: float = 3.0
    high_correlation: float = 0.9
    high_cardinality: float = 0.5
    numeric_share: float = 0.80
    datetime_share: float = 0.80
    datetime_skip_share: float = 0.5
    grade_a: int = 90
    grade_b: int = 80
    grade_c: int = 70
    grade_d: int = 60
    min_shared_rows: int = 10
    sample_ids: int = 50
    top_values: int = 5
    min_rows_for_fences: int = 4
    normality_rows: int = 8  # the moment test's normal scores need as many
    normality_alpha: float = 0.05
    pattern_min_rows: int = 10
    pattern_strength: float = 0.3
    pattern_max_p: float = 0.001
    pattern_listed: int = 5
    pattern_category_rows: int = 5
    kde_points: int = 300
    boxplot_sample: int = 300


DEFAULTS = Thresholds()
