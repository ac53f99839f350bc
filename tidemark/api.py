"""The library's entry points by task; each returns a DataFrame and leaves the physical plan to Spark."""

from __future__ import annotations

from .operators.clock import at_index, hermite, index_at, inverse, issues, robust_bpm, smooth, usable, warp_quality
from .operators.evidence import assess_ranges, phase_summary, phases, prefix_index, profiles, recurrence, window_stability
from .operators.kernel_ops import analyze, analyze_with_beats, anchors, beat_track, infer, log_mel, meter_regions, regularise, remove_duplicates, resample, stft_features, track_bars, valid_signals, yin_pitch
from .operators.facade import auto_transition, best_transition, declared_auto_transition, declared_transition, overlap_candidates, transition
from .operators.facade import overlap as plan_overlap
from .operators.guards import guard_ranges, latest_accepted_beat, matching_grid, prepared, reaudited, require_bars, song_bars, tracked_grid, with_pulse_support
from .operators.planning import bar_issues, coverage_runs, crossfade, cue_change, default_cue, inherited_tail, overlap, read_range, timeline_bounds
from .operators.repair import annotated_bars, beat_overlap, cue_evidence, match_events, octave_ratio, regions, song_affinity
from .operators.sequence import asof, complement, islands, longest_common_run, merge_intervals, nearest, range_join, upper_median, weighted_upper_median
from .operators.transitions import plan as plan_transitions
from .operators.transitions import plan_pulses
from .sources.audio import as_wav, checked_content, grid, raw_samples, whole_signals, write_audit

__all__ = [
    "analyze", "analyze_with_beats", "anchors", "annotated_bars", "as_wav", "asof", "assess_ranges", "at_index", "auto_transition", "bar_issues", "beat_overlap", "beat_track", "best_transition",
    "checked_content", "complement", "coverage_runs", "crossfade", "cue_change", "cue_evidence", "declared_auto_transition", "declared_transition", "default_cue", "grid", "guard_ranges",
    "hermite", "index_at", "infer", "inherited_tail", "inverse", "islands", "issues", "latest_accepted_beat", "log_mel", "longest_common_run", "match_events", "matching_grid", "merge_intervals",
    "meter_regions", "nearest", "octave_ratio", "overlap", "overlap_candidates", "phase_summary", "phases", "plan_overlap", "plan_pulses", "plan_transitions", "prefix_index", "prepared",
    "profiles", "range_join", "raw_samples", "read_range", "reaudited", "recurrence", "regions", "regularise", "remove_duplicates", "require_bars", "resample", "robust_bpm", "smooth",
    "song_affinity", "song_bars", "stft_features", "timeline_bounds", "track_bars", "tracked_grid", "transition", "upper_median", "usable", "valid_signals", "warp_quality",
    "weighted_upper_median", "whole_signals", "window_stability", "with_pulse_support", "write_audit", "yin_pitch",
]
