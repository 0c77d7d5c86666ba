"""Schemas of the tables, as DDL; nothing is inferred from data.

Pixels are whole numbers with both ends included; time is a double number of seconds, frequency of Hz.
"""

from __future__ import annotations

BOXES = "recording string, box_id long, freq_start long, freq_end long, t_start long, t_end long, label string, score double"
BOXES_SI = "recording string, time_start double, time_end double, freq_start double, freq_end double, label string"
SPEC_META = "recording string, t0 double, dt double, n_time long, f0 double, df double, n_freq long"
FRAMES = "recording string, frame long, mags array<double>"
MASK = "recording string, frame long, bin long, value int"
ANNOTATIONS = (
    "folder string, selection int, view string, channel int, begin_time double, end_time double, delta_time double, low_freq double, high_freq double, "
    "center_freq double, peak_freq double, begin_file string, delta_freq double, usv_type string"
)
RECORDINGS = "folder string, name string, sample_rate int, n_samples long, duration double"
SIGNAL_CHUNKS = "folder string, name string, sample_rate int, n_samples long, chunk_id long, sample_start long, samples array<float>"
NOISE_SPANS = "recording string, config_id string, start double, end double"
CONFIGS = "config_id string, num_iter double, smoothing double, flood_threshold double, balloon_latent double, sigma double"
PREDICTIONS = "recording string, chunk_id long, t_start double, freq_start double, t_end double, freq_end double, label_id int, score double"

#: The recordings key; most operators take other key columns (a model, a configuration) through ``keys``.
KEYS = ("recording",)
COORDS = ("t_start", "t_end", "freq_start", "freq_end")
GRID_COLUMNS = ("recording", "t0", "dt", "n_time", "f0", "df", "n_freq")
