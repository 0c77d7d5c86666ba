"""Acoustic event detection and scoring as Spark jobs: signal chunks, spectrogram frames, time/frequency boxes."""
