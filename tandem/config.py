"""Settings of a genotyping run; passed along, never changed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # reads and anchors
    anchor_length: int = 500
    min_anchor_overlap: int = 200
    min_end_qual: int = 17
    trim_window_size: int = 10
    max_trim: int = 50
    # quality control: hard limits, and limits under which robust outliers count
    min_str_qual: float = 20
    tol_str_qual: float = 30
    min_q10_str_quality: float = 15
    tol_q10_str_quality: float = 30
    max_error_rate: float = 0.01
    tol_error_rate: float = 0.005
    max_ref_divergence: float = 0.34
    min_n_outlier_detection: int = 10
    # genotyping
    min_haplotyping_depth: int = 10
    heterozygozity_alpha: float = 0.05
    min_sd: float = 0.05
    error_kmer: int = 11

    @property
    def min_var(self) -> float:
        return self.min_sd**2
