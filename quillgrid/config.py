"""Every constant of the page operators in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Four sets of region types that are kept apart on purpose.
LAYOUT_EXCLUDED = ("photo_region", "signature_area", "stamp_area", "logo_region", "decorative_box", "non_text_sparse_region", "non_text_candidate", "table_like_region", "checkbox_region")
PIPELINE_EXCLUDED = ("photo_region", "signature_area", "stamp_area", "logo_region", "decorative_box", "non_text_sparse_region")
SUPPORT_EXCLUDED = ("photo_region", "signature_area", "checkbox_region", "table_like_region", "stamp_area", "logo_region", "decorative_box")
PROCESS_EXCLUDED = ("non_text_sparse_region", "non_text_candidate", "photo_region", "signature_area", "table_like_region", "checkbox_region")
# Words of rows that label no field.
NOISE_WORDS = ("snb", "jspcb", "affix", "contd")


@dataclass(frozen=True)
class Config:
    """Thresholds in pixels unless said otherwise."""

    fallback_split: float = 300.0
    min_line_length: float = 100.0
    right_of: float = 300.0
    near_text: float = 30.0
    row_gap: float = 20.0
    table_gap: float = 15.0
    table_lines: int = 5
    rule_gap: float = 14.0
    rule_lines: int = 4
    merge_gap: float = 40.0
    column_cap: float = 620.0
    above: float = 10.0
    below: float = 75.0
    compare_distance: float = 36.0
    group_cap: int = 8
    depth_cap: int = 4


DEFAULT = Config()
